"""A store kept by change against the same index built anew."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import graph
from tarnwell.sources import ingest
from tarnwell.sources.segments import Segments

NAMES = ["load", "save", "run", "walk", "make", "keep"]


def render(rng, me):
    """A small module: imports of others, functions that call by name, names twice and names that are gone."""
    out = [f"from pkg.m{rng.randrange(7)} import {rng.choice(NAMES)}" for _ in range(rng.randrange(3))] + [f"import pkg.m{rng.randrange(7)}" for _ in range(rng.randrange(2))]
    for _ in range(rng.randrange(1, 4)):
        name = rng.choice([*NAMES, f"only_{me}_{rng.randrange(2)}"])
        out += [f"def {name}(x):", *[f"    {rng.choice([*NAMES, f'only_{rng.randrange(8)}_{rng.randrange(2)}'])}(x)" for _ in range(rng.randrange(3))], "    return x", ""]
    return "\n".join([*out, f"{rng.choice(NAMES)}(1)", ""])


def tables(index):
    """An index's relations with paths and names for ids."""
    path = index.files.select(F.col("id").alias("file_id"), "path")
    who = index.symbols.join(path, "file_id").select("id", F.concat_ws(":", "path", "name", "line_start").alias("who"))
    end = lambda c: who.select(F.col("id").alias(c), F.col("who").alias(f"{c}_who"))
    edges = index.call_edges.join(end("caller_id"), "caller_id").join(end("callee_id"), "callee_id", "left")
    closure = index.closure.join(end("symbol_id"), "symbol_id").join(end("caller_id"), "caller_id")
    out = {
        "files": index.files.select("path", "hash", "lang"), "symbols": index.symbols.join(path, "file_id").select("path", "name", "kind", "line_start", "line_end", "qualified_name"),
        "lines": index.lines.join(path, "file_id").select("path", "line_no", "text"), "calls": index.calls.join(path, "file_id").select("path", "line", "pos", "callee_name"),
        "call_edges": edges.select("caller_id_who", "callee_name", "line", "pos", "callee_id_who", "resolved_name", "callee_file"),
        "symbol_references": index.symbol_references.join(end("symbol_id"), "symbol_id").join(path, "file_id").select("symbol_id_who", "path", "line"),
        "imports": index.imports.join(path, "file_id").select("path", "module", "level", "is_star"), "closure": closure.select("symbol_id_who", "caller_id_who", "depth"),
        "name_uses": index.name_uses.join(path, "file_id").select("path", "name"),
    }
    return {n: sorted(map(str, map(tuple, df.collect()))) for n, df in out.items()}


@pytest.mark.parametrize("seed", [1])
def test_random_edits_equal_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    now, at = {}, ingest.Store(spark, str(tmp_path / "s"), with_closure=True)
    for turn in range(3):
        edits = {f"pkg/m{k}.py": render(rng, k) for k in rng.sample(range(8), 8 if not turn else 2)}
        gone = rng.sample(sorted(now), 1) if turn else []
        edits = {p: c for p, c in edits.items() if p not in gone}
        at.apply(spark.createDataFrame(list(edits.items()), "path string, content string"), spark.createDataFrame([(p,) for p in gone], "path string"))
        now = {p: c for p, c in (now | edits).items() if p not in gone}
        want = tables(ingest.build(spark, spark.createDataFrame(list(now.items()), "path string, content string")))
        got = tables(at.index())
        for n in want:
            assert got[n] == want[n], (turn, n)


def test_a_change_writes_what_it_changes(spark, tmp_path):
    """Of 300 files 3 change: rows written stay near that share, bytes below a twentieth."""
    body = lambda k, s: f"def f_{k}(x):\n    f_{k + 1}(x)\n    shared(x)\n    return x + {s}\n\ndef shared(x):\n    return x\n" + f"# {k} {s}\n" * 40
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    at = ingest.Store(spark, str(tmp_path / "s"))
    at.apply(frame([(f"m{k}.py", body(k, 0)) for k in range(300)]).repartition(4))
    size = lambda: {str(p): p.stat().st_size for p in tmp_path.rglob("*.parquet")}
    before = size()
    assert at.apply(frame([(f"m{k}.py", body(k, 1)) for k in (7, 100, 200)]).coalesce(1)) == 2
    after = size()
    assert all(after[p] == s for p, s in before.items())  # nothing is written over
    added = at.touched()
    assert added["files"] == (3, 3) and added["symbols"] == (6, 3) and added["facts"][0] < 60
    # f_7 and the others keep their id, `shared` stays ambiguous: only the changed files' own calls are resolved
    assert added["calls"] == (6, 6) and added["names"][0] < 40
    rows = sum(m["added"] for m in at.at.mark().values())
    assert rows < 0.05 * sum(m["n_rows"] for m in at.at.mark().values())
    at.apply(None, spark.createDataFrame([("m8.py",)], "path string"))
    assert at.touched()["calls"] == (1, 3)  # m7's call of f_8 has lost its target; m8's own two are gone
    assert at.apply(frame([("m9.py", body(9, 0))])) == 3  # as it was: no new version


def test_segments_merge_and_go_on(spark, tmp_path):
    at = Segments(spark, str(tmp_path / "t"), {"a": ("k long, v string", ["k"])})
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    read = lambda: sorted((r.k, r.v) for r in at.live("a").collect())
    assert read() == [] and not at.due()
    at.put(1, "a", rows((1, "x"), (2, "y"), (2, "z")))
    assert read() == []  # not committed yet
    at.commit(1)
    at.put(2, "a", rows((2, "n")), at.live("a").filter("k = 2"))
    at.commit(2)
    assert read() == [(1, "x"), (2, "n")] and at.due(batches=1) and not at.due()
    assert sorted((r.k, r.v) for r in at.live("a", 1).collect()) == [(1, "x"), (2, "y"), (2, "z")]
    at.put(3, "a", rows((9, "lost")))
    at.clean(3)  # a batch that was cut off
    assert at.merge() == 3 and read() == [(1, "x"), (2, "n")] and at.mark()["a"]["n_dead"] == 0
    at.put(4, "a", rows((1, "w")), at.live("a").filter("k = 1"))
    at.commit(4)
    assert read() == [(1, "w"), (2, "n")]
    with pytest.raises(RuntimeError):
        at.commit(4)  # another writer was faster


def depths(edges):
    """All pairs by plain search."""
    up, out = {}, set()
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    for s in up:
        seen, front, d = {}, {s}, 0
        while front:
            d += 1
            front = {y for x in front for y in up.get(x, ())} - set(seen)
            seen |= dict.fromkeys(front, d)
        out |= {(s, c, d) for c, d in seen.items()}
    return out


@pytest.mark.parametrize("seed", [3])
def test_closure_after_random_changes(spark, seed):
    rng = random.Random(seed)
    nodes = 14
    pick = lambda n: {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)}
    edges = pick(18)
    frame = lambda rows: spark.createDataFrame(sorted(rows), "callee_id long, caller_id long")
    closure = graph.closure(frame(edges))
    for _ in range(2):
        removed, added = set(rng.sample(sorted(edges), 4)), pick(4) - edges
        edges = edges - removed | added
        new, dead = graph.changed_closure(closure, frame(edges), frame(removed), frame(added))
        closure = spark.createDataFrame(closure.join(dead, ["symbol_id", "caller_id"], "left_anti").unionByName(new).collect(), "symbol_id long, caller_id long, depth int")
        assert {tuple(r) for r in closure.collect()} == depths(edges)
        assert closure.count() == len(depths(edges))
