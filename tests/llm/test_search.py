"""Joins, indexes, dedup and models against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_native import EMPTY, ODD, documents

from tarnwell.llm import components, decontamination, jaccard_join, resampling, suffix_dedup, toxicity

LOWER = {65 + i: 97 + i for i in range(26)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- decontamination -----------------------------------------------------------------------------------------------------
def contaminated(docs, bench):
    wins = {}
    for item, t in bench:
        w = TERM.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = Counter()
    for i, t, _ in docs:
        w = TERM.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for p in range(len(w)):
            for n in {len(x) for x in wins}:
                if p + n <= len(w) and (x := tuple(w[p : p + n])) in wins:
                    hit |= set(range(p, p + n))
                    items |= wins[x]
        out[i, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_contamination(spark):
    rng = random.Random(1)
    vocab = ["the", "of", "Été", "naïve", "x1", "Zed", "rare", "and", "日本"]
    bench = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([20, 14, 13, 5, 1, 0, 30, 13])] + [(50, None), (2, "other words entirely " * 5), (99, "never seen anywhere")]
    docs = []
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            src = TERM.findall(rng.choice(bench)[1] or "")
            a = rng.randrange(len(w) + 1)
            w[a:a] = src[rng.randrange(3) :]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w), "s"))
    docs += ODD
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontamination.contamination(documents(spark, docs), b).collect())
    assert got == contaminated(docs, bench)
    assert decontamination.contamination(documents(spark, EMPTY), b).count() == 0
    clean = decontamination.contamination(documents(spark, docs), b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.n_hit for r in clean)


def test_proximity(spark):
    b = spark.createDataFrame([(1, "alpha common beta common gamma")], "item_id long, text string")
    docs = [(1, "alpha common beta common gamma", "s"), (2, "alpha common and beta common gamma", "s"), (3, "gamma x x x x x x x x x alpha beta", "s"), (4, "alpha common", "s"), (5, "common " * 40, "s")]
    index = decontamination.build_index(documents(spark, docs), b)
    key = lambda r: int(r.key.split(":")[0])
    assert {key(r) for r in index.exact().collect()} == {1}
    assert {(key(r), r.off_by) for r in index.near(0).collect()} >= {(1, 0)}
    assert {key(r) for r in index.near(2).collect()} >= {1, 2}
    assert 4 not in {key(r) for r in index.near(50).collect()}


# --- jaccard -------------------------------------------------------------------------------------------------------------
def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(docs):
    sets = [shingles(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(s), low.get(find(k)) if s else i) for k, ((i, _, _), s) in enumerate(zip(docs, sets)))


@pytest.mark.parametrize(("few", "rounds", "block"), [(16, 4, 256), (2, 1, 3)])
def test_join(spark, few, rounds, block):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "c", "d", "é", "ff", "g", "h"]) + rng.choice(["", "1", "2", "x"])
    base = [[word() for _ in range(rng.choice([3, 8, 30, 90]))] for _ in range(14)]
    passage = [word() for _ in range(40)]
    docs = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if k % 9 == 0:
            w += passage
        docs.append((k, "\t".join(w) if k % 2 else " ".join(w).upper(), "s"))
    docs += ODD + [(900, " a  b ", "s"), (901, "A B", "s"), (902, "b a", "s")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(documents(spark, docs), few=few, rounds=rounds, block=block).collect())
    assert got == linked(docs)


def test_join_of_nothing(spark):
    assert jaccard_join.join(documents(spark, EMPTY)).count() == 0


def test_prefixes_share_enough():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 3, jaccard_join.BUCKETS).astype(np.int8)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 6 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            need = min(len(a), len(b)) // jaccard_join.SLACK
            assert len(np.intersect1d(jaccard_join.prefix(a, levels), jaccard_join.prefix(b, levels))) > need
            assert len(jaccard_join.other_prefixes(a)) == jaccard_join.ORDERS - 1
            for x, y in zip(jaccard_join.other_prefixes(a), jaccard_join.other_prefixes(b)):
                assert len(np.intersect1d(x, y)) > need


def test_pairs_that_another_order_parts_are_not_verified(spark):
    rng = np.random.default_rng(4)
    far = [np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64)) for _ in range(2)]
    far[1] = np.unique(np.concatenate([far[0][:15], far[1][15:]]))
    near = [far[0], np.concatenate([far[0][:95], far[1][-5:]])]
    rows = [(k, len(s), [], [h.view(np.int64).tolist() for h in jaccard_join.other_prefixes(s)]) for k, s in enumerate([*far, *near])]
    sets = spark.createDataFrame(rows, jaccard_join.SETS)
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    assert [tuple(r) for r in jaccard_join._under_all_orders(pairs, sets).collect()] == [(2, 3)]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (7, 5), (9, 9), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5} | {k: 10 for k in range(10, 16)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_joined_in_batches(spark):
    rng = np.random.default_rng(11)
    batches = [[(int(a), int(b)) for a, b in rng.integers(0, 300, (60, 2))] for _ in range(3)] + [[(k, k + 1) for k in range(400, 440)], [(440, 3), (5, 5)], []]
    parent = list(range(500))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    roots, seen = None, set()
    for batch in batches:
        roots = components.joined(roots, spark.createDataFrame(batch, "a long, b long"))
        for a, b in batch:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
            seen |= {a, b} if a != b else set()
        rows = roots.collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.root for r in rows} == {x: top(x) for x in seen}


# --- suffix dedup --------------------------------------------------------------------------------------------------------
def covered(seqs, length):
    """For each sequence, 1 for what is covered by `length` symbols that start anywhere else too."""
    seen = Counter(tuple(b[i : i + length]) for b in seqs for i in range(len(b) - length + 1))
    out = []
    for b in seqs:
        cut = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[tuple(b[p : p + length])] > 1:
                cut[p : p + length] = b"\1" * length
        out.append(cut)
    return out


def stripped(docs, length, words):
    raw = [(t or "").encode() for _, t, _ in docs]
    out = Counter()
    for (i, _, _), b, c, w in zip(docs, raw, covered(raw, length), covered([WORD.findall((t or "").translate(LOWER)) for _, t, _ in docs], words)):
        kept = bytes(x for x, y in zip(b, c) if not y)
        out[i, len(b), sum(c), len(re.findall(b"\1+", bytes(c))), hashlib.sha256(kept).hexdigest(), sum(w)] += 1
    return out


SHORT = {"length": 40, "gram": 8, "block": 4, "words": 12, "word_gram": 3}


def removed(spark, docs, **options):
    out = suffix_dedup.remove_repeats(documents(spark, docs), **(SHORT | options))
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.repeated_words) for r in out.collect())


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats(spark, batches):
    rng = random.Random(4)
    passages = ["".join(rng.choice("abé \n") for _ in range(n)) for n in (60, 90, 41, 200, 39)]
    docs = []
    for k in range(90):
        t = "".join(rng.choice(["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(70))), rng.choice(passages), rng.choice(passages)[5:]]) for _ in range(rng.randrange(1, 6)))
        docs.append((k, t, "s"))
    docs += [(200, docs[0][1], "s"), (201, "a" * 300, "s"), (202, "ab" * 150, "s"), *ODD[:-1], (4, "long " * 3000, "a")]
    assert removed(spark, docs, batches=batches) == stripped(docs, 40, 12)


def test_repeats_over_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    docs = [(1, long, "s"), (2, long[700:2600] + "tail" * 9, "s"), (3, "x" + long[1000:1100], "s"), (4, "é" * 900, "s")]
    assert removed(spark, docs) == stripped(docs, 40, 12)
    assert suffix_dedup.remove_repeats(documents(spark, EMPTY)).count() == 0


def test_a_passage_in_many_surroundings(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(55)
    docs = [(k, noise(rng.randrange(50)) + passage[rng.randrange(6) : rng.randrange(46, 55)] + noise(rng.randrange(50)), "s") for k in range(150)]
    assert removed(spark, docs) == stripped(docs, 40, 12)


def test_a_worker_holds_a_small_part_of_a_batch():
    """An executor's memory holds two of these workers beside its JVM."""
    text = random.Random(6).randbytes(1_000_000).hex()
    batch = pa.RecordBatch.from_pydict({"k1": range(8000), "k2": pa.array(range(8000), pa.int32()), "text": [text[k * 200 : k * 200 + 1500] + " x" * 100 for k in range(8000)]})
    measures = (suffix_dedup.Measure("bytes", 400, 64, 16), suffix_dedup.Measure("words", 51, 8, 8))
    span = [[{"unit": 0, "lo": 9 * k, "hi": 9 * k + 5} for k in range(30)]] * 8000
    for run, given in ((suffix_dedup._runs(measures), batch), (suffix_dedup._strip, pa.RecordBatch.from_pydict({"doc_id": range(8000), "text": batch.column("text"), "cuts": span}))):
        tracemalloc.start()
        rows = sum(out.num_rows for out in run([given]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= 8000 and peak < 48 << 20, (run, rows, peak)


def test_family_takes_batches_and_opens_again(spark, tmp_path):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcd ") for _ in range(70)) for _ in range(12)]
    docs = [(k, rng.choice(passages) + "".join(rng.choice("abcdefgh ") for _ in range(30)) + rng.choice(passages)[:60], "s") for k in range(60)]
    measures = (suffix_dedup.Measure("bytes", 40, 8, 4), suffix_dedup.Measure("words", 12, 3, 2))
    texts = suffix_dedup.keyed_texts(documents(spark, docs))
    runs = suffix_dedup.sampled(texts, measures)
    levels = []
    for k in range(5):
        family = suffix_dedup.Family(spark, str(tmp_path))  # from what is on disk
        family.add(runs.filter(f"pmod(k2, 5) = {k}"))
        levels.append(family.levels)
    assert levels == [[(0, 0)], [(0, 0), (1, 1)], [(0, 1), (2, 2)], [(0, 1), (2, 2), (3, 3)], [(0, 3), (4, 4)]]
    entries = family.entries()
    assert entries.agg({"n": "sum"}).first()[0] == runs.count()
    # a build that stopped before it deleted what it had merged, and one that stopped before its marks
    entries.limit(3).write.parquet(str(tmp_path / "level-2-2"))
    entries.limit(3).write.parquet(str(tmp_path / "level-5-5"))
    family = suffix_dedup.Family(spark, str(tmp_path))
    assert family.levels == [(0, 3), (4, 4)]
    cut = {(r.k1, r.k2): sorted((c.lo, c.hi) for c in r.cuts if c.unit == 0) for r in suffix_dedup.cuts(texts, runs, family, measures).collect()}
    want = {i: c for (i, _, _), c in zip(docs, covered([t.encode() for _, t, _ in docs], 40))}
    for r in texts.collect():
        mark = bytearray(len(want[r.doc_id]))
        for lo, hi in cut.get((r.k1, r.k2), []):
            mark[lo:hi] = b"\1" * (hi - lo)
        assert mark == want[r.doc_id]


def test_windows_of_a_content_are_told_as_one_stretch(spark, tmp_path):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(60)
    docs = documents(spark, [(k, noise(40) + passage[k % 7 : 60 - k % 5] + noise(40), "s") for k in range(60)])
    measures = (suffix_dedup.Measure("bytes", 40, 8, 4), suffix_dedup.Measure("words", 12, 3, 2))
    texts = suffix_dedup.keyed_texts(docs)
    runs = suffix_dedup.sampled(texts, measures)
    family = suffix_dedup.Family(spark, str(tmp_path))
    family.add(runs)
    shared = suffix_dedup._shared_windows(texts, runs, family, measures).collect()
    assert len(shared) > 30 and len(shared) == len({(r.gram, r.whole) for r in shared})  # before, a row for each window
    assert all(0 <= r.lo <= r.hi for r in shared) and any(r.lo < r.hi for r in shared)


def test_only_texts_that_lose_something_go_through_python(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [noise(45) for _ in range(3)]
    docs = [(1, passages[0] + noise(30) + passages[1], "s"), (2, noise(9) + passages[1] + passages[2], "s"), (3, passages[0] + passages[2], "s"), (4, noise(200), "s"), (5, None, "s"), (6, "", "s"), (4, "other " + noise(80), "s")]
    assert removed(spark, docs, kept=False) == removed(spark, docs) == stripped(docs, 40, 12)
    raw = [(t or "").encode() for _, t, _ in docs]
    rest = Counter((i, bytes(x for x, y in zip(b, c) if not y)) for (i, _, _), b, c in zip(docs, raw, covered(raw, 40)))
    out = suffix_dedup.remove_repeats(documents(spark, docs), **SHORT)
    assert Counter((r.doc_id, bytes(r.kept)) for r in out.collect()) == rest and sum(map(len, raw)) > sum(len(x) for _, x in rest)
    short = suffix_dedup.remove_repeats(documents(spark, docs), **SHORT, kept=False)
    assert short.columns == [c for c in out.columns if c != "kept"]
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("MapInArrow") and plan.count("MapInArrow") == 1


def test_spans_of_a_text_are_joined_where_they_touch():
    spans = [[(0, 3, 5), (0, 5, 9), (1, 0, 2), (0, 20, 30)], None, [], [(0, 0, 4), (0, 2, 3), (1, 1, 2), (1, 1, 3)], [(1, 0, 1)]]
    kind = pa.list_(pa.struct([("unit", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))
    cuts = pa.array([x and [dict(zip(("unit", "lo", "hi"), c)) for c in x] for x in spans], kind)
    texts = ["abcdefghijklmnopqrstuvwxyzabcdef", None, "whole", "abcd", "é e"]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(5), "text": texts, "cuts": cuts})
    for given in (batch, batch.slice(2)):  # a slice's lists don't begin at the first struct
        out = [r for x in suffix_dedup._strip([given]) for r in x.to_pylist()]
        want = {0: (32, 16, 2, 2, b"abcjklmnopqrstef"), 1: (0, 0, 0, 0, b""), 2: (5, 0, 0, 0, b"whole"), 3: (4, 4, 1, 2, b""), 4: (4, 0, 0, 1, "é e".encode())}
        assert [r["doc_id"] for r in out] == given.column("doc_id").to_pylist()
        for r in out:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["repeated_words"], r["kept"]) == want[r["doc_id"]]
            assert r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest()


# --- models --------------------------------------------------------------------------------------------------------------
def best_segments(values):
    """Maximal segments by definition: the best is cut out, then the same on both sides (first and shortest of equals)."""
    best = None
    for a in range(len(values)):
        s = 0.0
        for b in range(a, len(values)):
            s += values[b]
            if s > 0 and (best is None or s > best[0] + 1e-12):
                best = s, a, b + 1
    if best is None:
        return []
    s, a, b = best
    return best_segments(values[:a]) + [(a, b)] + [(x + b, y + b) for x, y in best_segments(values[b:])]


def test_segments():
    rng = random.Random(7)
    for _ in range(200):
        values = [rng.choice([-3.0, -1.1, -0.4, 0.7, 1.3, 2.9]) + rng.random() / 1000 for _ in range(rng.randrange(25))]
        assert [(a, b) for a, b, _ in toxicity.segments(values)] == best_segments(values)
    assert toxicity.segments([]) == [] and toxicity.segments([-1.0]) == []


def toxic_corpus(spark, n=700):
    rng = random.Random(8)
    usual, foul = [f"w{k}" for k in range(150)], ["grubby", "vileness", "wretch"]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(usual) for _ in range(rng.randrange(20, 120))]
        if k % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(foul) for _ in range(4)]
        rows.append((k, " ".join(w), "s"))
        labels.append((k, int(k % 5 == 0), 1))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), rows


def test_toxicity(spark):
    docs, labels, _ = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    held = [r for r in out if r.held_out]
    assert 80 < len(held) < 200 and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.segments for r in held if r.doc_id % 5 == 0)
    odd = toxicity.score(documents(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.5 for r in odd)
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(documents(spark, EMPTY), model).count() == 0


def test_resampling(spark):
    rng = random.Random(9)
    good, junk = [f"g{k}" for k in range(80)], [f"j{k}" for k in range(80)]
    rows = [(k, " ".join(rng.choice(good if k % 4 else junk) for _ in range(60)), "s") for k in range(800)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(300)], "doc_id long, quality int")
    out = resampling.resample(docs, labels).collect()
    assert sum(r.kept for r in out) == 600 and sum(r.kept and r.doc_id % 4 > 0 for r in out) >= 595
    again = resampling.resample(docs.repartition(5), labels).collect()
    assert {(r.doc_id, r.kept) for r in out} == {(r.doc_id, r.kept) for r in again}
    odd = resampling.resample(documents(spark, ODD), labels, share=0.5).collect()
    assert len(odd) == len(ODD) and sum(r.kept for r in odd) >= 3
    assert resampling.resample(documents(spark, EMPTY), labels).count() == 0
    assert {r.log_weight for r in resampling.resample(docs, labels.limit(0)).collect()} == {0.0}


def test_kth_largest(spark):
    df = spark.range(4000).selectExpr("id", "-1 - pmod(xxhash64(id), 1000003) / 1000003 AS x")
    values = sorted((r.x for r in df.collect()), reverse=True)
    for k in (1, 17, 2500, 4000):
        assert resampling.kth_largest(df, "x", k) == values[k - 1]


def test_hashed_ngrams():
    bucket, of = resampling.hashed_ngrams(["a B c", "", None or "a b", "\n"])
    one = lambda i: Counter(bucket[of == i].tolist())
    assert sum(one(0).values()) == 5 and sum(one(2).values()) == 3 and not one(1) and not (one(2) - one(0))


def test_toxicity_is_fitted_on_all_significant_segments(spark, monkeypatch):
    docs, labels, rows = toxic_corpus(spark, 300)
    bad = {r.doc_id for r in labels.collect() if r.toxic == 1}
    filler = " " + " ".join(t for i, t, _ in rows if i not in bad and t)[:300] + " "
    long = [(i, filler.join([t] * 30) if i in bad else t, s) for i, t, s in rows]
    shaped, shape = [], toxicity._shape
    monkeypatch.setattr(toxicity, "_shape", lambda best, high: shaped.append(list(high)) or shape(best, high))
    model = toxicity.train(documents(spark, long), labels)
    scores = toxicity.Scores(model["ratios"].value)
    own = {round(e[2], 6): len(e[0]) for _, t, _ in long for e in [toxicity.evidence([scores[w] for w in toxicity.tokens(t)], model["lam"], model["k"])]}
    assert {round(h, 6) for h in shaped[0]} <= set(own)
    assert max(own[round(h, 6)] for h in shaped[0]) > 8


def test_weights_by_brute_force(spark):
    rng = random.Random(11)
    docs = [(k, " ".join(rng.choice("red Green blue x yy zzz".split()) for _ in range(rng.randrange(30))), "s") for k in range(60)] + [(60, None, "s"), (61, "", "s")]
    labels = [(k, int(rng.random() < 0.4)) for k in range(0, 50)]
    got = {r.doc_id: r for r in resampling.resample(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"), share=0.5).collect()}
    grams = {i: Counter(resampling.hashed_ngrams([t or ""])[0].tolist()) for i, t, _ in docs}
    good = {i for i, y in labels if y}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i in good else {})
    ratio = lambda b: np.log((target[b] + 1) / (target.total() + resampling.BUCKETS)) - np.log((raw[b] + 1) / (raw.total() + resampling.BUCKETS))
    for i, g in grams.items():
        assert got[i].log_weight == pytest.approx(sum(n * ratio(b) for b, n in g.items()), abs=1e-9)
    best = sorted(got, key=lambda i: -got[i].draw)[: round(0.5 * len(docs))]
    assert {i for i, r in got.items() if r.kept} == set(best)


def test_scores_by_brute_force(spark):
    rng = random.Random(12)
    ratios = {"=vile": 9.0, "=nice": 0.3, "4vile": 4.0, "=meh": 1.5}
    model = {"ratios": spark.sparkContext.broadcast(ratios), "lam": 0.9, "k": 0.2, "beta": np.array([-3.0, 0.8, 0.5])}
    docs = [(k, " ".join(rng.choice("vile nice meh vilely other, Vile! word".split()) for _ in range(rng.randrange(25))), "s") for k in range(40)] + [(40, None, "s"), (41, "", "s")]
    got = {r.doc_id: r for r in toxicity.score(documents(spark, docs), model).collect()}

    def value(w):
        out = 1.0
        for k in (*[f"{n}{w[:n]}" for n in (4, 5, 6) if len(w) > n], "=" + w):
            out = ratios.get(k, out)
        return np.log(out) - toxicity.DRIFT

    for i, t, _ in docs:
        values = [value(w.strip(toxicity.STRIP)) for w in (t or "").lower().split()]
        cut = np.log(0.2 * max(1, len(values)))
        evidence = [0.9 * sum(values[a:b]) - cut for a, b, *_ in toxicity.segments(values)]
        high = sum(e for e in evidence if e >= -np.log(toxicity.SIGNIFICANT))
        best = max(evidence, default=-cut)
        x = -3.0 + 0.8 * np.clip(best, -10, 40) + 0.5 * np.log1p(max(high, 0))
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.5)
    assert {r.predicted for r in got.values()} == {0, 1}


def test_ratios_by_brute_force(spark):
    docs, labels, rows = toxic_corpus(spark, 300)
    ratios = toxicity.train(docs, labels)["ratios"].value
    used = labels.filter(~toxicity.held_out(F.col("doc_id"))).filter("pmod(xxhash64(doc_id, 1), 4) > 0")
    label = {r.doc_id: r.toxic for r in used.collect()}
    counts = Counter((k, label[i]) for i, t, _ in rows if i in label for w in t.split() for k in toxicity.keys(w))
    words = Counter(label[i] for i, t, _ in rows if i in label for _ in t.split())
    # every word of the fit counts, however rare, and words that it lacks keep the ratio of their prefixes
    for w in ["grubby", "vileness", "wretch", "wretched", "grubbily", "never"] + [f"w{k}" for k in range(150)]:
        got = want = 1.0
        for k in toxicity.keys(w):
            got = ratios.get(k, got)
            want = (counts[k, 1] + toxicity.PRIOR * want) / (counts[k, 0] * words[1] / words[0] + toxicity.PRIOR)
        assert got == pytest.approx(want, rel=1e-5)


def test_toxicity_of_odd_labels(spark):
    docs, labels, rows = toxic_corpus(spark, 300)
    odd = spark.createDataFrame([(None, 1), (5, None), (6, 7), (10, 0), (10, 1), (10, 1)], "doc_id long, toxic int")
    again = toxicity.train(docs, labels.select("doc_id", "toxic").unionByName(odd))
    first = toxicity.train(docs, labels)
    assert (again["ratios"].value.toxic == first["ratios"].value.toxic).all() and again["lam"] == first["lam"]
    clashing = docs.withColumn("score", F.lit("x")).withColumn("text_", F.lit(1)).withColumn("toxic", F.lit(9)).withColumn("l_id", F.lit(3))
    assert sorted(toxicity.score(clashing, first).collect()) == sorted(toxicity.score(docs, first).collect())
    assert sorted(toxicity.score(docs, toxicity.train(clashing, labels)).collect()) == sorted(toxicity.score(docs, first).collect())
