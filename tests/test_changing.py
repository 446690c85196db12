"""Streams with state, trees on disk, logs of diffs, the call graph without all pairs, work that is stopped and goes on."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import embed
from tarnwell.operators import graph, history
from tarnwell.sources import ingest, store, tree
from tarnwell.streaming import changes, state

ROW = "k int, at int, v string"


def test_newest_rows_are_state(spark, tmp_path):
    put = lambda *r: spark.createDataFrame(r, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put((1, 1, "a"), (2, 5, "b"), (4, None, "n"), (5, 1, None), (5, 1, "x"))
    run = lambda: state.keep_newest(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), "k", ("at",), str(tmp_path / "ck"))
    before = spark.conf.get(state.PROVIDER, None)
    run().awaitTermination()
    assert spark.conf.get(state.PROVIDER, None) == before
    put((1, 2, "c"), (2, 4, "late"), (3, 1, "e"), (4, 0, "later than null"))
    again = run()  # a new run goes on from the checkpoint
    again.awaitTermination()
    got = {(r.k, r.at, r.v) for r in state.held(spark, str(tmp_path / "ck")).collect()}
    assert got == {(1, 2, "c"), (2, 5, "b"), (3, 1, "e"), (4, 0, "later than null"), (5, 1, "x")} and state.state_rows(again) == 5


def test_a_reader_that_joins_late_gets_the_ring_and_then_what_comes(spark, tmp_path):
    put = lambda *r: spark.createDataFrame(r, state.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: state.run_follow(spark.readStream.schema(state.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), size=2).awaitTermination()
    put(("a", 1, None, "one"), ("a", 2, None, "two"), ("a", 3, None, "three"), ("b", 1, None, "other"), ("a", 2, "early", None))
    run()
    put(("a", 4, "late", None), ("a", 5, None, "five"), ("a", 6, "late", None), ("a", 7, None, None))
    run()
    got = {}
    for r in spark.read.schema(state.SENT).parquet(str(tmp_path / "out")).orderBy("at").collect():
        got.setdefault(r.reader, []).append((r.log, r.at, r.text, r.live))
    assert got["early"] == [("a", 1, "one", False), ("a", 2, "two", False), ("a", 3, "three", True), ("a", 5, "five", True), ("a", 7, None, True)]
    assert got["late"] == [("a", 2, "two", False), ("a", 3, "three", False), ("a", 5, "five", True), ("a", 7, None, True)] and len(got) == 2


@pytest.fixture
def folder(tmp_path):
    for p in ("src/a.py", "src/deep/er/b.RS", "src/c.txt", "build/x.py", "build-2/y.py", "node_modules/pkg/z.js", "egg/t.egg-info/e.py", "m.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x\xff\n")
    os.symlink("/nowhere/at/all", tmp_path / "build" / "broken.py")  # opening it would fail
    return tmp_path


@pytest.mark.parametrize("folders", [1, 100])
def test_skipped_folders_are_not_entered(spark, folder, folders):
    paths = lambda **o: {r.path for r in tree.listing(spark, str(folder), folders=folders, **o).collect()}
    assert paths() == {"src/a.py", "src/deep/er/b.RS", "build-2/y.py", "egg/t.egg-info/e.py", "m.go"}
    assert paths(skip=("build", "*.egg-info"), joined=True) == {"src/a.py", "src/deep/er/b.RS", "node_modules/pkg/z.js", "m.go"}
    assert paths(skip=("build", "node_modules"), suffixes=()) == {"src/a.py", "src/deep/er/b.RS", "src/c.txt", "build-2/y.py", "egg/t.egg-info/e.py", "m.go"}
    reader = tree.TreeReader({"root": str(folder), "folders": "3"})
    dealt = [p.value.removeprefix(str(folder)) for p in reader.partitions()]
    assert not any("node_modules" in p or p == "/build" for p in dealt) and "/src" in dealt


def test_content_is_read_last(spark, folder):
    (folder / "build" / "gone.py").write_text("")
    files = tree.listing(spark, str(folder), skip=())
    got = tree.with_content(files.filter("path in ('src/a.py', 'build/gone.py', 'build/broken.py')"), str(folder)).collect()
    assert {(r.path, r.content) for r in got} == {("src/a.py", "x�\n"), ("build/gone.py", "")}  # a dangling link is left out
    index = ingest.build_tree(spark, str(folder), with_closure=False)
    assert index.files.count() == 5


LOG = """commit 1a|2024-01-01|first | with bar

diff --git a/x.py b/x.py
new file mode 100644
--- /dev/null
+++ b/x.py
@@ -0,0 +1,3 @@
+++ b/fake
+@@ -1 +1 @@
+rename to me
diff --git a/a b.py b/a b.py
--- a/a b.py
+++ b/a b.py
@@ -3,2 +3 @@ def f():
-x
@@ -9 +8,0 @@
-y
commit 2b|2024-01-02|no files
commit broken line
diff --git a/q.py b/q.py
@@ -1 +1 @@
commit 3c|2024-01-03|others

diff --git a/old.py b/new.py
similarity index 90%
rename from old.py
rename to new.py
--- a/old.py
+++ b/new.py
@@ -4,0 +5,2 @@
+a
diff --git a/b.png b/b.png
Binary files a/b.png and b/b.png differ
diff --git a/s.sh b/s.sh
old mode 100644
new mode 100755
diff --git a/z.py b/z.py
deleted file mode 100644
--- a/z.py
+++ /dev/null
@@ -1 +0,0 @@
-gone"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_diffs_of_a_log(spark, tmp_path, end):
    (tmp_path / "log").write_bytes(LOG.replace("\n", end).replace("\r\ncommit", "\ncommit").encode())
    log = history.read_diffs(spark, str(tmp_path / "log"))
    files = [(r.commit_hash, r.path, r.old_path, r.kind) for r in history.diff_files(log).collect()]
    assert files == [("1a", "x.py", None, "new"), ("1a", "a b.py", "a b.py", "changed"), ("3c", "new.py", "old.py", "renamed"), ("3c", "b.png", "b.png", "binary"), ("3c", "s.sh", "s.sh", "mode"), ("3c", "z.py", "z.py", "deleted")]
    hunks = history.diff_hunks(log)
    assert [(r.commit_hash, r.path, r.start, r["count"]) for r in hunks.collect()] == [("1a", "x.py", 1, 3), ("1a", "a b.py", 3, 1), ("3c", "new.py", 5, 2)]
    assert hunks.first().commit_msg == "first | with bar"


def test_ranges_that_share_many_bins_meet_once(spark):
    rng = random.Random(4)
    span = lambda: sorted((rng.randrange(1, 2000), rng.randrange(1, 2000)))
    symbols = [(k, rng.randrange(3), *span()) for k in range(80)]
    hunks = [(f"c{k % 25}", "d", "m", rng.randrange(3), "p", rng.randrange(1, 2000), rng.choice([1, 3, 700])) for k in range(80)]
    got = history.index_hunks(spark.createDataFrame(hunks, "commit_hash string, commit_date string, commit_msg string, file_id long, path string, start int, count int"), spark.createDataFrame(symbols, "id long, file_id long, line_start int, line_end int"))
    want = {}
    for c, _, _, f, _, start, count in hunks:
        for s, of, a, b in symbols:
            if f == of and (n := min(b, start + count - 1) - max(a, start) + 1) > 0:
                want[s, c] = want.get((s, c), 0) + n
    assert {(r.symbol_id, r.commit_hash): r.lines_added for r in got.collect()} == want


def components(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    ends = {x for e in edges for x in e}
    far = {}
    for s in ends:
        seen, todo = set(), [s]
        while todo:
            for y in up.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        far[s] = seen
    return {s: min([s, *(t for t in far[s] if s in far[t])]) for s in ends}


@pytest.mark.parametrize(("seed", "nodes", "n"), [(1, 30, 45), (2, 12, 30)])
def test_strong_components(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)} | {(100, 100)}
    frame = spark.createDataFrame(sorted(edges), "callee_id long, caller_id long")
    want = components(edges)
    found = graph.strong_components(frame)
    assert {r.id: r.component for r in found.collect()} == want and len(set(want.values())) < len(want)
    between = {tuple(r) for r in graph.condensed(frame, found).collect()}
    assert between == {(want[a], want[b]) for a, b in edges if want[a] != want[b]}


def test_reach_is_the_closure_of_one(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame(sorted({(rng.randrange(15), rng.randrange(15)) for _ in range(22)}), "callee_id long, caller_id long")
    whole = graph.closure(edges).collect()
    for start in (0, 3, 7):
        got = graph.reach(edges, spark.createDataFrame([(start,)], "symbol_id long"))
        assert {tuple(r) for r in got.collect()} == {(r.caller_id, r.depth) for r in whole if r.symbol_id == start}


def test_steps_delete_what_they_wrote(spark):
    folder = store.shared_dir(spark)
    before = set(os.listdir(folder))
    with store.steps(spark):
        assert store.rows_of(store.written(spark.range(7))) == 7 and set(os.listdir(folder)) != before
        assert store.rows_of(store.written(spark.range(7).filter("id > 9"))) == 0
    assert set(os.listdir(folder)) == before


def test_a_store_tells_what_it_does(spark, tmp_path, monkeypatch):
    told = []
    at = ingest.Store(spark, str(tmp_path / "s"), on_event=told.append)
    frame = lambda **c: spark.createDataFrame([(f"{k}.py", v) for k, v in c.items()], "path string, content string")
    at.apply(frame(a="x = 1", b="y = 1", c="z = 1"))
    at.apply(frame(a="x = 1", b="y = 2", d="w = 1"), spark.createDataFrame([("c.py",), ("none.py",)], "path string"))
    assert [t["event"] for t in told] == ["start", "done", "start", "done"]
    assert [(t["indexed"], t["skipped"], t["deleted"]) for t in told if t["event"] == "done"] == [(3, 0, 0), (2, 1, 1)]
    with monkeypatch.context() as m:
        m.setattr(ingest.extract, "extract", lambda files: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            at.apply(frame(a="x = 3"))
    assert told[-1]["event"] == "error" and "ZeroDivisionError" in told[-1]["message"]


def test_a_stream_tells_what_it_does(spark, tmp_path):
    spark.createDataFrame([(1, None, "a.py", "created", None, "x = 1"), (2, None, "b.py", "deleted", None, None)], changes.CHANGE).write.parquet(str(tmp_path / "in"))
    told = []
    listener = changes.Events(told.append)
    spark.streams.addListener(listener)
    try:
        changes.maintain(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "ck")).awaitTermination()
        for _ in range(100):
            if told and told[-1]["event"] == "done":
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0]["event"] == "start" and told[-1]["event"] == "done"
    assert {"rows": 2, "changes": 2, "deletes": 1, "moves": 0}.items() <= next(t for t in told if t["event"] == "progress").items()


def test_an_embedding_run_that_was_stopped_goes_on(spark, tmp_path):
    files = spark.createDataFrame([(f"m{k}.py", f"def name_{k}(x):\n    return x\n") for k in range(30)], "path string, content string")
    index = ingest.build(spark, files, with_closure=False)
    job = embed.EmbeddingJob(spark, str(tmp_path / "v"), slices=4)
    assert job.enable(False)["enabled"] is False and job.run(index)["done"] == 0
    job.enable(True)
    first = job.run(index, after=lambda s: threading.Thread(target=job.stop).start() or threading.Event().wait(1))
    assert not first["running"] and 0 < first["done"] < 30 and first["error"] is None
    part = {r.symbol_id: r.embedding for r in job.vectors().collect()}
    done = embed.EmbeddingJob(spark, str(tmp_path / "v"), slices=3).run(index)
    assert (done["done"], done["total"]) == (30, 30)
    vectors = {r.symbol_id: r.embedding for r in job.vectors().collect()}
    assert len(vectors) == 30 and part.items() <= vectors.items()
    assert vectors == {r.symbol_id: r.embedding for r in embed.embed_symbols(index).collect()}
    index.symbols = index.symbols.filter(F.col("name") != "name_3")
    assert job.run(index)["done"] == 29


def test_embedding_puts_texts_together_once_a_run(spark, tmp_path, monkeypatch):
    sources = spark.createDataFrame([(f"m{k}.py", f'def f{k}():\n    """Does {k}."""\n    return {k}\n\nclass C{k}: pass\n') for k in range(6)], "path string, content string")
    index = ingest.build(spark, sources, with_closure=False)
    made, texts = [], embed.symbol_texts
    monkeypatch.setattr(embed, "symbol_texts", lambda *a: made.append(a) or texts(*a))
    job = embed.EmbeddingJob(spark, str(tmp_path / "v"), slices=3)
    assert job.run(index)["done"] == 12 and len(made) == 1
    want = {r.symbol_id: embed.encode(r.text) for r in texts(index).collect()}
    assert {r.symbol_id: r.embedding for r in job.vectors().collect()} == want and len(want) == 12
    assert {r.text for r in texts(index).collect()} >= {"function f3 Does 3. \"\"\"Does 3.\"\"\" return 3", "class C3"}
