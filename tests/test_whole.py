"""Queries that go all the way, against plain Python."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import graph
from tarnwell.plans import queries
from tarnwell.plans.derive import derive


@pytest.fixture(scope="module")
def index(spark, sf):
    return derive(spark, sf)


def reached(steps, start, limit=10**9):
    """Depth by what is reached, breadth first; the start only if a way leads back to it."""
    depth, frontier, at = {}, {start}, 0
    while frontier and at < limit:
        at += 1
        frontier = {y for x in frontier for y in steps.get(x, ())} - set(depth)
        depth |= dict.fromkeys(frontier, at)
    return depth


def by(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


def test_closure_query_has_all_depths(spark, sf, index):
    up = by((r.callee_id, r.caller_id) for r in graph.live_edges(index).collect())
    want = {(s, c, d) for s in up for c, d in reached(up, s).items()}
    assert {tuple(r) for r in queries.QUERIES["closure"](spark, sf).select("symbol_id", "caller_id", "depth").collect()} == want
    assert max(d for *_, d in want) > 3


def test_blast_radius_query_has_all_depths(spark, sf, index, monkeypatch):
    up = by((r.callee_id, r.caller_id) for r in graph.live_edges(index).collect())
    first = {r.name: r.id for r in index.symbols.groupBy("name").agg(F.min("id").alias("id")).collect()}
    name = max(first, key=lambda n: (max(reached(up, first[n]).values(), default=0), n))
    monkeypatch.setattr(queries, "ROOT", name)
    depths = list(reached(up, first[name]).values())
    assert max(depths) > 3
    assert {tuple(r) for r in queries.QUERIES["blast_radius_full"](spark, sf).collect()} == {(d, depths.count(d)) for d in depths}


def test_trace_query_goes_five_deep(spark, sf, index):
    edges = {(r.caller_name, r.callee_name, r.caller_file, r.caller_line) for r in graph.edge_view(index).collect()}
    depth = reached(by((b, a) for a, b, *_ in edges), queries.CALLEE, 5)
    depth[queries.CALLEE] = 0
    want = {(*e, depth[e[0]]) for e in edges if e[1] in depth and depth.get(e[0]) == depth[e[1]] + 1}
    assert {tuple(r) for r in queries.QUERIES["trace"](spark, sf).collect()} == want
    assert max(w[-1] for w in want) == 5


def test_endpoint_flow_query_goes_eight_deep(spark, monkeypatch):
    rows = [(f"n{c}", f"n{chr(ord(c) + 1)}") for c in "abcdefghijk"] + [("nd", "nb")]
    names = sorted({n for e in rows for n in e})
    files = spark.createDataFrame([(1, "f.py")], "id long, path string")
    symbols = spark.createDataFrame([(k, 1, n, "function", k) for k, n in enumerate(names)], "id long, file_id long, name string, kind string, line_start int")
    calls = spark.createDataFrame([(names.index(a), b) for a, b in rows], "caller_id long, callee_name string")
    monkeypatch.setattr(queries, "START", "na")
    monkeypatch.setattr(queries, "derive", lambda *_: SimpleNamespace(files=files, symbols=symbols, call_edges=calls))
    assert {(r.name, r.depth) for r in queries.QUERIES["endpoint_flow"](spark, "").collect()} == {(n, d) for d, n in enumerate(names[:9])}


def test_symbol_sources_of_every_kind(spark, sf, index):
    lines = {(r.file_id, r.line_no): r.text for r in index.lines.collect()}
    want = {r.id: "\n".join(lines[r.file_id, k] for k in range(r.line_start, r.line_end + 1)) for r in index.symbols.collect()}
    rows = queries.QUERIES["symbol_sources_all"](spark, sf).collect()
    assert len(rows) == len(want) and {r.id: r.source for r in rows} == want
    assert {r.kind for r in rows} == {"function", "method", "interface", "class"}
