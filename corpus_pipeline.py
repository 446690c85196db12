"""A corpus pipeline of the package's operators: quality rules, line dedup, near duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import decontamination, jaccard_join, line_dedup, mixing, quality_rules
from tarnwell.llm.common import keyed, materialize, small, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the learned rules reject."""
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.filter("not kept").select("key"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with texts that have lost their source's boilerplate lines, and n_chars after them."""
    out = line_dedup.line_dedup(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest id, and one row of it. Texts without words all stay."""
    found = materialize(jaccard_join.join(docs).filter("n_shingles > 0").select("root", "doc_id", "key"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one")).select(F.col("one.key").alias("key"))
    left = without(docs, found.select("key").join(kept, "key", "left_anti"))
    # rows that repeat as a whole share a key; of those only one is to stay
    again = found.groupBy("key").count().filter("count > 1").select("key").join(kept, "key", "left_semi")
    once = keyed(left).join(small(again), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return without(left, again).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark windows cover a twentieth of the words."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated").select("key"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the learned rules; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
