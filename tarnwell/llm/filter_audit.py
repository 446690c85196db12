"""Audit of how filters interact: parity sums of failure masks, inverted to counts, and all orders evaluated from those."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import materialize, table, words

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LABELS = ("every", "good", "toxic")


def failed(text: Column) -> Column:
    """Bits 0 to 3: what a text fails by itself: too short, too repetitive, too many capitals, a symbol."""
    w = words(text)
    text = F.coalesce(text, F.lit(""))
    fails = (
        F.size(w) < 50,
        100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        F.regexp_like(text, F.lit("[#$%&*|]")),
    )
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: documents with these flags; bit 4 is set where a smaller id has the same text.

    A text's smallest id comes from one combined aggregation, and rows meet it by text and id together, so a text that
    thousands share is in no task as a whole. Texts are compared by SHA-256.
    """
    d = docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), failed(F.col("text")).alias("mask"))
    d = materialize(d.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    first = d.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    met = d.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    no = F.lit(False)
    return met.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (F.col("mask") + copy).alias("mask"), "n")


def _sign(a: Column, b: Column) -> Column:
    """-1 or 1: the parity of the bits that both have."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, label, w: for each set of filters (a mask) the sum over documents of 1, negative where an odd number of the
    set's filters fail. Documents of label 1 count again under their labels."""
    named = F.array_compact(F.array(F.lit(LABELS[0]), *[F.when(F.col(c), F.lit(c)) for c in LABELS[1:]]))
    each = rows.select("part", F.explode(named).alias("label"), "mask", "n")
    sums = [F.sum(F.col("n") * _sign(F.col("mask"), F.lit(s))).alias(f"w{s}") for s in range(MASKS)]
    return each.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"w{s}" for s in range(MASKS)]).alias("w"))


def _over_masks(value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), value)


def _total(value) -> Column:
    """Sum of value(mask) over all masks."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda acc, m: acc + value(m))


def cells(sums: DataFrame) -> DataFrame:
    """part and, for each label, the count of documents with each mask: the sums' transform again, a 32nd of it, which is
    whole in integers."""
    inverse = _over_masks(lambda m: F.shiftright(_total(lambda s: _sign(m, s) * F.get("w", s)), len(FILTERS)))
    counted = sums.select("part", "label", inverse.alias("n"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return counted.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == k, F.col("n"))), none).alias(k) for k in LABELS])


def evaluate(counts: DataFrame) -> DataFrame:
    """One row a part, order and step, from the counts of masks alone."""
    past = lambda k: _over_masks(lambda p: _total(lambda m: F.when(m.bitwiseAND(p) == 0, F.get(k, m)).otherwise(F.lit(0).cast("long"))))
    share = _over_masks(lambda f: _total(lambda m: F.when(m.bitwiseAND(f) != 0, F.get("every", m) * F.floor(F.lit(len(ORDERS)) / F.bit_count(m))).otherwise(F.lit(0).cast("long"))))
    left = counts.select("part", "every", *[past(k).alias(f"{k}_left") for k in LABELS], share.alias("share"))
    steps = left.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.get(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.substring("filter_order", i, F.lit(1))) - 1))
    steps = steps.withColumn("bits", bits).withColumn("own", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)).withColumn("after", F.col("before") + F.col("own"))
    lost = lambda k: F.get(f"{k}_left", F.col("before")) - F.get(f"{k}_left", F.col("after"))
    fails = F.get("every_left", F.lit(0)) - F.get("every_left", F.col("own"))
    return steps.select(
        "part", "filter_order", "step", F.get("every_left", F.col("after")).alias("kept"), lost("every").alias("removed"), (fails - lost("every")).alias("redundant"), F.get("every", F.col("own")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("share", F.col("own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all 120 orders of
    five filters, for each source, from 32 parity sums a source and label.

    A document with c failures is removed by each of those filters in 120 / c orders, which gives the Shapley counts.
    Null texts are empty, and so fail the first filter; a null source and an empty one are the same part. A row without an
    id is no copy and makes none; repeated rows each count, and are no copies of each other, as none has a smaller id. An
    id with several labels is good (toxic) if any of them says so; labels of unknown ids and null labels don't count. Texts
    are taken whole, whatever their length. An empty table has no parts and no rows. Columns beside doc_id, text and source
    are not read, so their names can't clash.
    """
    return evaluate(cells(parity_sums(masks(docs, labels))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH low AS (SELECT coalesce(text, '') AS t, min(doc_id) AS low FROM documents GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > low, false)} AS x FROM d JOIN low USING (t)),
m AS (SELECT f.part, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS bad,
    count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS prior FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, own, contains(bad, own) AS fails, regexp_matches(bad, '[_' || prior || ']') AS gone, bad, n, good, toxic FROM m, s),
e AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM e
"""
