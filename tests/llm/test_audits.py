"""Source divergence, license scan and filter audit against plain Python and SQL, and their edge cases."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from tarnwell.llm import divergence, filter_audit, licenses, oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_license_scan", "op13_filter_audit"])
def test_query_equals_sql(name, spark, sf):
    df = queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(oracle_sql()[name])
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


# op11


def words(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def diverge(rows, least, top):
    """By the definition: each group and each language gives each kept term its share."""
    docs, n = Counter(), defaultdict(Counter)
    groups = {(r[2] or "", r[3] or "") for r in rows}
    for _, text, lang, source in rows:
        w = words(text)
        docs.update((lang or "", t) for t in set(w))
        n[lang or "", source or ""].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (k, t), c in docs.items() if k == lang and c >= least)
        here = {g: {t: n[g][t] for t in kept} for g in groups if g[0] == lang}
        here[None] = {t: sum(c[t] for c in here.values()) for t in kept}
        p = {g: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for g, c in here.items()}
        for g in (g for g in here if g):
            pairs = [(sum(abs(p[g][t] - p[o][t]) for t in kept), o[1]) for o in here if o and o != g]
            terms = [(p[g][t] - p[None][t], t) for t in kept if here[g][t] and p[g][t] > p[None][t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(*g, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "block"), [(1, 3, 2), (2, 5, 1), (30, 50, 256)])
def test_divergence_by_definition(spark, monkeypatch, least, top, block):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)] + ["Ünï", "ΩΩ", "𝒳y"]
    rows = []
    for k in range(150):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "ß", "d", "e"])
        shift = (source or "z").encode()[0] * 7
        rows.append((k, " ".join(vocabulary[int(rng.paretovariate(1) * 3 + shift * rng.random() ** 4) % len(vocabulary)] for _ in range(rng.randrange(60))), lang, source))
    rows += [(200, None, "en", "only null"), (201, "123 ...", "xx", "no terms"), (202, "", "xx", "none"), rows[3], rows[3], (None, "wAA waa WAA", "en", "a")]
    monkeypatch.setattr(divergence, "LEAST_DOCS", least)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "3 as value")
    got = sorted(tuple(r) for r in divergence.audit(docs, top=top, block=block).collect())
    assert got == diverge(rows, least, top)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_with_counts_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n, total, terms = 9_000_000_000_000, 10**16, 7
    got = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 35)


def test_bounds_stop_the_search(spark):
    """Rare terms of a group lie in buckets whose bound is below its best ones, and aren't evaluated."""
    rows = [(k, "common " * 40 + "mine " * 30 + " ".join(f"t{chr(97 + j)}" for j in range(20)), "en", "abc"[k % 3]) for k in range(90)]
    rows += [(100 + k, f"special{chr(97 + k)} " * 400, "en", "a") for k in range(3) for _ in range(30)]
    postings, groups = divergence.tables(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = [tuple(r) for r in divergence.overused(postings, groups, top=2).filter("source = 'a'").orderBy("rank").collect()]
    assert [(r[2], r[4]) for r in got] == [("speciala", 1), ("specialb", 2)] and got[0][3] == got[1][3]


# op12


def scan(spark, given, **options):
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").selectExpr("*", "'x' as w", "1 as hits", "2 as labels")
    return {r.doc_id: r for r in licenses.scan(rows, **options).collect()}


def test_licenses_and_their_places(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [
        "Released under the MIT License. The mit\nlicense!", "Licensed under the Apache License, Version 2.0.", "GNU Lesser General Public License", mit,
        "Permission is hereby granted for ever. " + "word " * 30 + "free of charge to any person obtaining a copy",  # too far apart
        "Permission is hereby granted, quite free of charge, to any person obtaining a copy",  # a word more
        "free of charge to any person obtaining a copy; permission is hereby granted",  # the wrong order, but near
        None, "", "mitlicense mit-licence", "MIT LİCENSE", "general public public license", "cc by nc 4.0, CC BY-NC-SA 4.0", "mit " * 500 + "license " + "mit license " * 300,
    ]
    got = scan(spark, texts)
    assert [(p.label, p.start) for p in got[0].places] == [("mit", 3), ("mit", 6)] and got[0].labels == ["mit", "mit-notice"]
    assert got[1].labels == ["apache", "apache-2.0"] and got[1].score == pytest.approx(0.95)
    assert got[2].labels == ["gpl", "lgpl"]
    assert got[3].labels == ["mit-text"] and got[3].score == pytest.approx(0.9)
    assert got[4].labels == [] and got[4].score == 0
    assert got[5].labels == ["mit-text"]
    assert got[6].labels == []
    assert [got[k].n_words for k in (7, 8)] == [0, 0] and got[7].labels == got[8].labels == []
    assert got[9].labels == [] and got[10].labels == [] and got[11].labels == []
    assert got[12].labels == ["cc-by-nc-4.0", "cc-by-nc-sa-4.0"]
    assert len(got[13].places) == 301 and got[13].places[0].start == 499


def test_licenses_by_definition(spark):
    """Every text of a small alphabet against all places and all windows."""
    import random

    rng = random.Random(5)
    base, texts, slop = (("one", "a b"), ("two", "b b")), (("x", "[a c] d [c]"), ("y", "[b a b]"), ("z", "[d] a a a [d d] [a]"), ("gone", "[nowhere a]")), 2
    docs = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(200)]
    found = licenses.phrases(base, texts)
    for k, r in scan(spark, docs, base=base, texts=texts, slop=slop).items():
        w = docs[k].split()
        places = lambda p, w=w: [i for i in range(len(w)) if tuple(w[i : i + len(p.words)]) == p.words]
        want = sorted((p.label, i) for p in found if p.base for i in places(p))
        labels = {p.label for p in found if p.base and places(p)}
        for n in {p.licence for p in found if not p.base}:
            own = [{i - p.offset for i in places(p)} for p in found if p.licence == n]
            if any(all(any(x <= y <= x + slop for y in ys) for ys in own) for xs in own for x in xs):
                labels |= {p.label for p in found if p.licence == n}
        assert sorted((p.label, p.start) for p in r.places) == want and r.labels == sorted(labels), docs[k]


def test_licenses_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_an_index_takes_the_rarest_words():
    found = licenses.phrases((("m", "mit license"),), (("t", "x [free of] y [charge]"),))
    index = licenses.build_index({"mit": 3, "license": 9, "free": 1, "of": 50, "charge": 7}, found)
    assert {(a, at) for a, at, _ in index.postings} == {("mit", 0), ("free", 0), ("charge", 0)} and index.leads == ("free", "mit")
    assert [p.offset for p in found] == [0, 1, 4]
    assert licenses.build_index({"mit": 3, "free": 1, "of": 1, "charge": 1}, found).leads == ("charge",)


# op13


def failures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)))) if bad}


def audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    low = {}
    for d, text, *_ in rows:
        if d is not None:
            low[text or ""] = min(d, low.get(text or "", d))
    each = [(r[3] or "", r[0], failures(r[1] or "") | ({"E"} if r[0] is not None and low[r[1] or ""] < r[0] else set())) for r in rows]
    out = {}
    for part in {e[0] for e in each}:
        for order in map("".join, permutations("ABCDE")):
            left = [e for e in each if e[0] == part]
            for step, f in enumerate(order, 1):
                gone = [e for e in left if f in e[2]]
                every = [e for e in each if e[0] == part and f in e[2]]
                left = [e for e in left if f not in e[2]]
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(e[2] == {f} for e in every), sum(e[1] in good for e in gone), sum(e[1] in toxic for e in gone)]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_by_definition(spark):
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Aa", "b", "C", "dd", "e$", "f", "gg", "h", "i"] + [f"u{j}" for j in range(rng.randrange(1, 200))]) for _ in range(rng.choice([0, 5, 60, 90]))) for _ in range(40)]
    rows = [(rng.choice([k, k, None]), rng.choice([*texts, None, "", "same " * 70]), "en", rng.choice(["a", "b", None, ""])) for k in range(160)]
    rows += [rows[0], rows[1], rows[1], (500, "x " * 60_000, "en", "long")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 220, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as part", "2 as mask", "3 as quality")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "4 as source")
    got = filter_audit.audit(docs, marks).collect()
    want = audit(rows, labels)
    assert len(got) == len(want) == 120 * 5 * len({r[3] or "" for r in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, None, None)], DOCS), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.removed + r.kept + r.redundant == 1 for r in one if r.filter_order[r.step - 1] == "A")


def test_parity_sums_invert_to_counts(spark):
    rows = spark.createDataFrame([("p", False, False, m, (m * m) % 7 + (m == 31) * 10**15) for m in range(32)], "part string, good boolean, toxic boolean, mask int, n long")
    got = filter_audit.cells(filter_audit.parity_sums(rows)).first()
    assert got.every == [(m * m) % 7 + (m == 31) * 10**15 for m in range(32)] and got.good == [0] * 32
