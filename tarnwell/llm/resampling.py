"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k draw."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import materialize, row_key, table
from tarnwell.llm.hashing import mix, pieces, word_hashes

#: Buckets of hashed unigrams and bigrams; labelled rows that the target model is fitted on at most.
BUCKETS, TARGET_ROWS = 1 << 14, 20_000
#: Rows of a histogram bin that are brought to the driver at most when the k-th key is looked for.
LAST_BIN = 5_000


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each unigram and bigram, index of its text). Words are runs of anything but ASCII white space, A-Z lower-cased."""
    h, of = word_hashes(texts)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = of[1:] == of[:-1]
    pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same]
    return (np.concatenate([h, pair]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([of, of[1:][same]])


def _count(batches):
    sums = np.zeros((2, BUCKETS), np.int64)
    for batch, texts in pieces(batches, "text"):
        bucket, of = hashed_ngrams(texts)
        target = np.array(batch.column("target").to_pylist(), bool)
        sums[0] += np.bincount(bucket, minlength=BUCKETS)
        sums[1] += np.bincount(bucket[target[of]], minlength=BUCKETS)
    if sums[0].any():
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "raw": sums[0], "target": sums[1]})


def _scorer(ratio: np.ndarray):
    def score(batches):
        for batch, texts in pieces(batches, "text"):
            bucket, of = hashed_ngrams(texts)
            sums = np.bincount(of, ratio[bucket], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sums, pa.float64())], ["doc_id", "key", "log_weight"])

    return score


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value: histograms narrow the range until the bin that holds it is small, and only that is read."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    x, bins = F.col(column), 4096
    while True:
        held = df.filter((x >= lo) & (x <= hi))
        if lo == hi or held.limit(LAST_BIN + 1).count() <= LAST_BIN:
            values = sorted((r[0] for r in held.select(x).collect()), reverse=True) if lo < hi else []
            return values[k - 1] if lo < hi else lo
        width = (hi - lo) / bins
        at = F.least(F.floor((x - lo) / width), F.lit(bins - 1)) if width else F.lit(0)
        counts = sorted(((r[0], r[1], r[2], r[3]) for r in held.groupBy(at.alias("bin")).agg(F.count("*"), F.min(x), F.max(x)).collect()), reverse=True)
        for _, n, low, high in counts:
            if k <= n:
                lo, hi = low, high
                break
            k -= n


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None, target_rows: int = TARGET_ROWS, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, draw, kept: one row a document; `kept` marks the draw of k = share x rows without replacement.

    The raw model counts hashed unigrams and bigrams of all texts, the target model those of labelled rows of label 1, at
    most `target_rows` of them by hash of the id. A text weighs the sum of the log ratios of its n-grams; with Gumbel noise
    added (from a hash of the row, so reruns agree) the k largest are a sample in proportion to the weights. `share` is the
    part of label 1 among labelled rows if not given. Rows of one draw enter together.

    Null and empty texts weigh 0. Repeated rows draw alike. Without target rows all ratios are 0. An empty table gives no
    rows. Columns other than id and text are not looked at.
    """
    spark = docs.sparkSession
    lab = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("label")).filter("label in (0, 1) and l_id is not null")
    if share is None:
        share = lab.agg(F.avg("label")).first()[0]
        share = 1.0 if share is None else share
    chosen = lab.filter("label = 1").select("l_id").distinct().orderBy(F.xxhash64("l_id"), "l_id").limit(target_rows)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the bound on the broadcast is target_rows ids
    marked = d.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"), "left").select("text", F.col("l_id").isNotNull().alias("target"))
    counts = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in counts.collect():  # BUCKETS rows at most
        raw[b], target[b] = r, t
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)) if target.any() else np.zeros(BUCKETS)
    keyed = d.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    scored = keyed.mapInArrow(_scorer(ratio), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, key string, log_weight double")
    uniform = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    scored = materialize(scored.withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform))))
    n = scored.count()
    k = round(share * n)
    least = kth_largest(scored, "draw", k) if k else None
    return scored.select("doc_id", "log_weight", "draw", (F.col("draw") >= least if k else F.lit(False)).alias("kept"))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
