"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.llm.common import WORD, materialize, row_key, small, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
#: Rows that one ranking group should hold at most, about.
GROUP_ROWS = 200_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target.

    Sources take the weights in turn by code point, null last. The weighted shares of `share` times all words stop at
    `cap` times a source's size, and what is above is dealt again by weight until none is above. One row a source is
    ranked and kept; a round of the dealing brings two sums to the driver.
    """
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    sizes = materialize(sizes.select("source", "source_size", weight.alias("w"), (F.lit(cap) * F.col("source_size")).alias("top")))
    row = sizes.agg(F.sum("source_size"), F.sum("w")).first()
    total = share * (row[0] or 0)
    level = total / row[1] if row[1] else 0.0
    while True:
        above = F.lit(level) * F.col("w") > F.col("top")
        row = sizes.agg(F.sum(F.when(above, F.col("top")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        new = (total - row[0]) / row[1] if row[1] else level
        if new == level:
            break
        level = new
    wanted = F.lit(level) * F.col("w")
    return sizes.select("source", "source_size", F.least(wanted, F.col("top")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, group_rows: int = GROUP_ROWS) -> DataFrame:
    """key, doc_id, source, size, source_size, target, copies: how often the mix takes each row.

    Within its source every row expects target / source_size copies. Rows are laid out by size, so that the sample is
    even over short and long texts; the prefix sum of expected copies plus one offset for each source is cut at the
    integers, and a row is taken once for each integer in its stretch. The prefix is a rank times a constant, and the
    rank is a group's start plus a place in the group: groups are (source, size, first digits of the id's MD5), with digits
    only where a size of a source has over `group_rows` rows. As rows go by size, MD5 and key, groups follow each other in
    that order, and the rank is the same for any `group_rows`; a hot source is ranked by many tasks.

    Null or empty texts have size 0 and take no words. A null source is a source. Repeated rows are rows of their own
    (they share a key; which of them is taken more often doesn't matter). An empty table gives none. Other columns are
    not looked at.
    """
    text = F.col(text_col)
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            row_key(F.col(id_col), text).alias("key"),
        )
    )
    counts = materialize(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    digits = F.ceil(F.log2(F.col("n") / F.lit(group_rows)) / 4).cast("int")
    deep = counts.filter(F.col("n") > group_rows).select(F.col("source").alias("s"), F.col("size").alias("z"), digits.alias("digits"))
    slim = slim.withColumn("mark", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("g")))  # null ids last
    slim = slim.join(small(deep), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    slim = slim.withColumn("part", F.substring("mark", F.lit(1), F.coalesce("digits", F.lit(0)))).drop("s", "z", "digits")
    groups = slim.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("size", "part").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    t, g, d = targets.alias("t"), groups.alias("g"), slim.alias("d")
    groups = g.join(t, F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.source", "g.size", "g.part", "g.start", "t.source_size", "t.target").alias("g")
    place = W.partitionBy("source", "size", "part").orderBy("mark", "key")
    ranked = d.withColumn("place", F.row_number().over(place) - 1).alias("d")
    same = F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.size") == F.col("g.size")) & (F.col("d.part") == F.col("g.part"))
    rows = ranked.join(groups, same).select("d.key", "d.doc_id", "d.source", "d.size", "g.source_size", "g.target", (F.col("g.start") + F.col("d.place")).alias("rank"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "source").cast("binary"))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    cut = lambda rank: F.floor(each * rank + offset)
    copies = cut(F.col("rank") + 1) - cut(F.col("rank"))
    return rows.select("key", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with all its columns.

    The number of repeated rows under a key is dealt with by their total, so each row of a key is emitted once for
    every copy that falls to it in turn.
    """
    chosen = mix(docs, id_col=id_col, text_col=text_col, **options).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(docs[id_col], docs[text_col]).alias("key"))
    lone = packed.join(chosen.filter((F.col("rows") == 1) & (F.col("copies") > 0)), "key").select("row", F.col("copies").cast("int").alias("copies"))
    # repeated rows are equal under the key but for other columns, so any stable order of them will do
    turn = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(F.to_json("row")))) - 1
    many = packed.join(chosen.filter((F.col("rows") > 1) & (F.col("copies") > 0)), "key").withColumn("turn", turn)
    share = F.floor(F.col("copies") * (F.col("turn") + 1) / F.col("rows")) - F.floor(F.col("copies") * F.col("turn") / F.col("rows"))
    many = many.select("row", share.cast("int").alias("copies")).filter("copies > 0")
    both = lone.unionByName(many)
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(text, '') AS text
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         2.0::DOUBLE * sum(size)::DOUBLE AS top
  FROM d GROUP BY source),
lv AS (
  SELECT 0 AS k, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(w) AS level FROM s
  UNION ALL
  SELECT k + 1, (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE - sum(CASE WHEN lv.level * w > top THEN top ELSE 0.0 END))
                 / nullif(sum(CASE WHEN lv.level * w > top THEN 0.0 ELSE w END), 0.0) FROM s)
  FROM lv WHERE k < 60 AND level IS NOT NULL),
fin AS (SELECT level FROM lv WHERE level IS NOT NULL ORDER BY k DESC LIMIT 1),
t AS (SELECT s.*, least(fin.level * w, top) AS target FROM s, fin),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
         ('0x' || substr(md5(concat_ws(':', 'mix', d.source)), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(d.doc_id::VARCHAR), d.text) - 1 AS p
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor(e * (p + 1) + u) - floor(e * p + u)) * size)::BIGINT AS taken
FROM r
"""
