"""Graph, vectors, history, text functions, logs, SQL and streams on small inputs."""

import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.functions import embed, logs, textops
from tarnwell.operators import graph, history, vector
from tarnwell.plans import sqldoor
from tarnwell.sources import ingest, scan
from tarnwell.streaming import changes


def test_closure_on_a_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3)], "callee_id long, caller_id long")  # 1 calls 2 calls 3 calls 1
    got = {(r.symbol_id, r.caller_id): r.depth for r in graph.closure(edges).collect()}
    assert len(got) == 9 and got[1, 1] == got[2, 2] == 3 and got[2, 1] == 1 and got[3, 1] == 2


def test_closure_is_transitive_and_shortest(spark):
    import random

    random.seed(4)
    pairs = {(random.randrange(12), random.randrange(12)) for _ in range(25)}
    got = {(r.symbol_id, r.caller_id): r.depth for r in graph.closure(spark.createDataFrame(sorted(pairs), "callee_id long, caller_id long")).collect()}
    want, frontier, depth = {}, {(a, b) for a, b in pairs}, 1
    while frontier:
        want |= {p: depth for p in frontier}
        frontier, depth = {(a, c) for a, b in frontier for x, c in pairs if x == b and (a, c) not in want}, depth + 1
    assert got == want


def test_trace(spark):
    rows = [("b", "a", "f", 1), ("c", "b", "f", 2), ("d", "c", "f", 3), ("c", "a", "f", 2)]
    got = {(r.caller, r.callee): (r.depth, r.chain) for r in graph.trace(spark.createDataFrame(rows, "caller_name string, callee_name string, caller_file string, caller_line int"), "a").collect()}
    assert got == {("b", "a"): (1, "b -> a"), ("c", "a"): (1, "c -> a"), ("d", "c"): (2, "d -> c -> a")}


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], [])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(vector.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0, 1.0, math.inf, math.inf]


def test_history(spark):
    hunks = spark.createDataFrame([("h", "2024-01-01", "m", 1, "p", 10, 5), ("h", "2024-01-01", "m", 1, "p", 30, 1)], "commit_hash string, commit_date string, commit_msg string, file_id long, path string, start int, count int")
    syms = spark.createDataFrame([(1, 1, 8, 12), (2, 1, 30, 30), (3, 1, 50, 60)], "id long, file_id long, line_start int, line_end int")
    assert {(r.symbol_id, r.lines_added) for r in history.index_hunks(hunks, syms).collect()} == {(1, 3), (2, 1)}
    heads = spark.createDataFrame([("@@ -1,2 +10,5 @@",), ("@@ -3 +30 @@",)], "h string").select(history.hunk_range(F.col("h")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in heads] == [(10, 5), (30, 1)]
    log = history.parse_log(spark.createDataFrame([("abc|2024-01-01|fix a|b",), ("junk",)], "value string")).collect()
    assert [tuple(r) for r in log] == [("abc", "2024-01-01", "fix a|b")]
    change = spark.createDataFrame([([], ["a"]), (["a"], []), (["def f():"], ["def f(x):"]), (["def f():", "1"], ["def f():", "2"])], "o array<string>, n array<string>")
    assert [r[0] for r in change.select(history.classify_change(F.col("o"), F.col("n"))).collect()] == ["new", "deleted", "signature_change", "logic_edit"]


def test_fuzzy_replace():
    code = "def f():\n    a = 1\n    b = 2\n    return a\n"
    assert textops.fuzzy_replace(code, "a = 1", "a = 9")[0] == code.replace("a = 1", "a = 9")
    assert textops.fuzzy_replace(code, "a = 1\nb = 2", "x")[0] == "def f():\nx\n    return a\n"
    assert textops.fuzzy_replace(code, "def f():\n    a = 1\n    b = 3\n    return a", "x")[0] == "x\n"
    assert textops.fuzzy_replace(code, "b  =   2", "x")[0] == "def f():\n    a = 1\nx\n    return a\n"
    assert textops.fuzzy_replace("x\nx\n", "x", "y")[1] == "the text to replace occurs more than once"
    assert textops.fuzzy_replace("x\nx\n", "x", "y", replace_all=True)[0] == "y\ny\n"
    assert textops.fuzzy_replace("a", "b", "c")[1] == "the text to replace was not found"
    assert textops.fuzzy_replace("a", "a", "a")[1] and textops.fuzzy_replace("a", "", "a")[1]
    assert list(textops.escape_normalized("a\nb", "a\\nb")) == ["a\nb"] and list(textops.trimmed_boundary("a b", "\na b\n")) == ["a b"]
    assert textops.best_match("    b = 2", code)[0] == 2 and textops.best_match("zzz", code) is None


@settings(max_examples=60, deadline=None)
@given(st.text("abc \n", max_size=40), st.text("abc \n", min_size=1, max_size=6), st.text("xyz\n", max_size=5))
def test_unique_exact_text_is_replaced_as_by_str(content, old, new):
    if content.count(old) == 1 and old != new:
        assert textops.fuzzy_replace(content, old, new)[0] == content.replace(old, new)


@settings(max_examples=40, deadline=None)
@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_edit_distance(a, b):
    d = textops.edit_distance(a, b)
    assert d == textops.edit_distance(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_previews(spark):
    rows = spark.createDataFrame([("a.py", "x = 1\r\ny = 2\n", "x = 1", "x = 3"), ("b.py", "q", "nope", "x")], "path string, content string, old_code string, new_code string")
    done = textops.preview_edits(rows)
    got = {r.path: r.preview for r in done.collect()}
    assert got["a.py"].new_content == "x = 3\ny = 2\n" and got["a.py"].lines_changed == 2 and got["b.py"].error
    assert textops.edit_rows(done).count() == 1
    assert textops.legacy_preview(rows).first().new_content == "x = 3\r\ny = 2\n"
    assert textops.preview_edits(rows, "ast").first().preview.error is None


def test_logs(spark):
    raw = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    ruff = '[{"filename":"a.py","code":"E501","message":"long","location":{"row":3,"column":7}}]'
    got = {tuple(r)[2:] for r in logs.parse_ruff(raw(ruff, "b.py:1:2: W291 space\nFound 1 error")).collect()}
    assert got == {("a.py", 3, 7, "error", "E501", "long"), ("b.py", 1, 2, "warning", "W291", "space")}
    assert tuple(logs.parse_tsc(raw("src/a.ts(4,5): error TS2304: no name")).first())[2:] == ("src/a.ts", 4, 5, "error", "TS2304", "no name")
    maven = logs.parse_maven(raw("[ERROR] /x/A.java:[3,4] ; expected\n[ERROR] BUILD FAILURE\n[ERROR] plugin broke\n[ERROR] ------")).collect()
    assert [(r.file, r.line, r.message) for r in maven] == [("/x/A.java", 3, "; expected"), ("", 0, "plugin broke")]
    assert tuple(logs.parse_go(raw("./m.go:7:2: undefined: x")).first())[2:5] == ("./m.go", 7, 2)
    cargo = '{"reason":"compiler-message","message":{"message":"bad","level":"error","code":{"code":"E1"},"spans":[{"file_name":"x.rs","line_start":1,"column_start":1,"is_primary":false},{"file_name":"m.rs","line_start":9,"column_start":2,"is_primary":true}]}}\n{"reason":"build-finished"}'
    assert tuple(logs.parse_cargo(raw(cargo)).first())[2:] == ("m.rs", 9, 2, "error", "E1", "bad")
    run = logs.parse_pytest(raw("FAILED t.py::a - x\nE   assert 1\n1 failed, 2 passed in 3s\n2 failed, 5 passed, 1 error")).first()
    assert (run.passed, run.failed, run.errors, run.failures) == (5, 2, 1, ["t.py::a - x"])
    assert tuple(logs.count_outcomes(raw("ok\nFAIL\nError: x\n1 passed")).first())[1:] == (2, 1, 1)
    assert logs.only_file(logs.parse_go(raw("a.go:1:1: x\nb.go:1:1: y")), "b.go").count() == 1


def test_findings(spark):
    report = '{"results":[{"check_id":"a.b.rule","path":"x.py","start":{"line":1,"col":2},"end":{"line":3,"col":4},"extra":{"message":"m","severity":"ERROR","lines":"code","metadata":{}}}]}'
    rows = scan.scan_findings(spark.createDataFrame([(report,)], "value string"))
    r = rows.first()
    assert (r.rule, r.severity, r.file, r.line_start, r.confidence) == ("rule", "HIGH", "x.py", 1, 0.8) and scan.finding_summary(rows).first().n_files == 1


def test_sql_door(spark):
    spark.range(3).createOrReplaceTempView("door")
    assert sqldoor.query_result(spark, "WITH x AS (SELECT id FROM door WHERE id > ?) SELECT sum(id) AS s FROM x UNION ALL SELECT (SELECT max(id) FROM door)", [0])["rows"] == [[3], [2]]
    for bad in ("DROP VIEW door", "CREATE TABLE t AS SELECT 1", "INSERT INTO door VALUES (1)", "SET a=b", "CACHE TABLE door", "WITH x AS (SELECT 1 AS a) INSERT INTO door SELECT * FROM x", "TRUNCATE TABLE door", "REFRESH TABLE door"):
        with pytest.raises(sqldoor.Refused):
            sqldoor.run_query(spark, bad)
    with pytest.raises(ValueError):
        sqldoor.run_query(spark, "SELEC 1")


def test_settle_and_maintain(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1, 0, 0, n)
    log = [(1, at(1), "a.py", "created", None, "def a():\n    b()\n"), (2, at(2), "b.py", "created", None, "def b():\n    pass\n"), (3, at(3), "a.py", "modified", None, "def a():\n    pass\n"), (4, at(4), "b.py", "moved", "c.py", "def b():\n    pass\n")]
    frame = spark.createDataFrame(log, changes.CHANGE)
    up, gone = changes.settle(frame)
    assert {r.path for r in up.collect()} == {"a.py", "c.py"} and {r.path for r in gone.collect()} == {"b.py"}
    frame.filter("event_id <= 2").coalesce(1).write.parquet(str(tmp_path / "log"))
    run = lambda: changes.maintain(spark, str(tmp_path / "log"), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    run()
    frame.filter("event_id > 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run()
    index = ingest.Store(spark, str(tmp_path / "store")).index()
    assert {r.path for r in index.files.collect()} == {"a.py", "c.py"} and index.call_edges.count() == 0


def test_embeddings(spark):
    index = ingest.build(spark, spark.createDataFrame([("a.py", 'def load_file(path):\n    """Read a file."""\n    return open(path)\n\ndef add(a, b):\n    return a + b\n')], "path string, content string"), with_closure=False)
    vectors = embed.embed_symbols(index).cache()
    assert vectors.count() == 2 and len(vectors.first().embedding) == embed.DIMENSIONS
    near = vector.semantic(vectors, index.symbols, index.files, embed.encode("read file load"), 1).first()
    assert near.name == "load_file"
    assert embed.embed_symbols(index, vectors).count() == 0 and vector.similar(vectors, index.symbols, index.files, "add").first().name == "load_file"
