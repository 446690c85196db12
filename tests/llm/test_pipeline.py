"""The pipeline's stages against plain Python, one by one."""

from collections import Counter

import pytest
from test_native import WORDS, stats
from test_search import contaminated, linked

import corpus_pipeline as pipeline
from tarnwell.llm import quality_rules
from tarnwell.llm.common import materialize


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf)))
    return docs


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark, sf, steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert all(d.columns == steps[0].columns for d in steps)
    start, judged, lined, lone, clean, mixed = steps
    base = {i for i, t, _ in rows(start) if (s := stats(t))[0] < 50 or 100 * s[4] > 50 * s[0]}
    kept = {r.doc_id for r in judged.collect()}
    assert not kept & base
    verdict = {r.doc_id for r in quality_rules.judge(start, spark.read.parquet(f"{sf}/labels.parquet")).filter("kept").collect()}
    assert kept == verdict

    assert lined.count() == judged.count()
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    groups = {i: c for i, _, c in linked(rows(lined))}
    assert Counter(i for i, *_ in rows(lone)) == Counter(set(groups.values()))

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, *_ in rows(clean)} == {k[0] for k in contaminated(rows(lone), bench) if not k[4]}

    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows(clean)}
    taken = Counter(i for i, *_ in rows(mixed))
    assert set(taken) <= set(size) and max(taken.values()) <= 2
    words = sum(size[i] * n for i, n in taken.items())
    assert abs(words - 1.5 * sum(size.values())) < 20 * max(size.values())


def test_near_duplicates_of_repeated_rows(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, None), (None, "q")], "doc_id long, text string")
    out = Counter((r.doc_id, r.text) for r in pipeline.near_duplicate_stage(spark, docs, sf).collect())
    assert out == Counter({(1, "a b c d e f"): 1, (3, None): 2, (None, "q"): 1})


def test_run(spark, sf, steps):
    assert pipeline.run(spark, sf).count() == steps[-1].count()
