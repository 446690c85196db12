"""Ids, the store, upserts, streams and the SQL door."""

import pytest

from tarnwell.plans import sqldoor
from tarnwell.sources import ingest, store
from tarnwell.streaming import changes


def sources(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


@pytest.mark.parametrize("room", [40, 1000])
def test_no_two_paths_share_an_id(spark, room):
    paths = sources(spark, [(f"p{k}.py", "") for k in range(35)])
    first = {r.path: r.id for r in ingest.with_ids(paths, room=room).collect()}
    assert len(set(first.values())) == 35 and max(first.values()) < room
    taken = spark.createDataFrame([(i, p) for p, i in first.items()], "id long, path string")
    more = sources(spark, [(f"p{k}.py", "") for k in range(33, 38)])
    then = {r.path: r.id for r in ingest.with_ids(more, taken, room=room).collect()}
    assert then["p33.py"] == first["p33.py"] and then["p34.py"] == first["p34.py"]
    assert not {then[f"p{k}.py"] for k in (35, 36, 37)} & set(first.values()) and len(set(then.values())) == 5


def test_a_store_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    at = ingest.Store(spark, str(tmp_path / "s"))
    at.apply(sources(spark, [("a.py", "def a():\n    pass\n"), ("b.py", "def b():\n    a()\n")]))
    change = sources(spark, [("a.py", "def c():\n    pass\n")])
    with monkeypatch.context() as m:
        m.setattr(ingest.extract, "extract", lambda files: 1 / 0)  # files are written, facts are not
        with pytest.raises(ZeroDivisionError):
            at.apply(change)
    assert at.version() == 1
    assert at.apply(change) == 2
    index = at.index(with_closure=False)
    assert {r.name for r in index.symbols.collect()} == {"b", "c"}
    assert [r.callee_id for r in index.call_edges.collect()] == [None]
    assert at.apply(None, spark.createDataFrame([("b.py",)], "path string")) == 3
    assert {r.path for r in at.index(with_closure=False).files.collect()} == {"a.py"}


def test_the_last_row_of_a_key_stays(spark, tmp_path):
    new = spark.createDataFrame([(1, "x", 3), (1, "y", 2), (2, "z", 1), (3, None, 1)], "k int, v string, at int")
    old = spark.createDataFrame([(1, "o"), (9, "p")], "k int, v string")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], ["at"]).collect()), key=str) == [(1, "x"), (2, "z"), (3, None), (9, "p")]
    at = ingest.Store(spark, str(tmp_path / "s"))
    at.apply(spark.createDataFrame([("a.py", "x = 1", 2), ("a.py", "x = 2", 1)], "path string, content string, n int"), order=["n"])
    assert [r.content for r in at.live("files").collect()] == ["x = 1"]


def test_only_a_local_session_may_choose_its_folder(spark):
    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        store.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "/shared/"
    assert store.shared_dir(Session()) == "/shared"


REFUSED = (
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT upper(java_method('java.lang.System', 'getProperty', 'user.dir'))", "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM tw_door WHERE EXISTS (SELECT 1 FROM text.`/etc/hostname`)", "WITH a AS (SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir') AS x) SELECT * FROM a",
    "SELECT id FROM tw_door WHERE id = (SELECT max(length(reflect('java.lang.System', 'getProperty', 'user.dir'))) FROM tw_door)", "SELECT * FROM other_table", "INSERT INTO tw_door VALUES (1)", "DROP TABLE tw_door",
)


@pytest.mark.parametrize("statement", REFUSED)
def test_the_door_refuses(spark, statement):
    spark.range(3).createOrReplaceTempView("tw_door")
    with pytest.raises(sqldoor.Refused):
        sqldoor.run_query(spark, statement)


def test_the_door_reads(spark):
    spark.range(3).createOrReplaceTempView("tw_door")
    assert sqldoor.run_query(spark, "WITH a AS (SELECT id FROM tw_door) SELECT sum(id) AS s FROM a WHERE id IN (SELECT id FROM tw_door WHERE id > ?)", [0]).first().s == 3
    with pytest.raises(sqldoor.Refused):
        sqldoor.run_query(spark, "SELECT * FROM tw_door", views=["another"])
