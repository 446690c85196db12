"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

from collections import Counter
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import table

#: Labelled rows of each class that the classifier is fitted on at most, and buckets of its table of counts.
TRAIN_ROWS, BUCKETS = 8_000, 1 << 21
#: Weight of a prior in tokens, drift that is taken from each token's score, and lengths of the prefixes that are backed off to.
PRIOR, DRIFT, PREFIXES = 2.0, 0.3, (4, 5, 6)
#: A segment is significant if fewer than this many would be expected in a clean text of that length.
SIGNIFICANT = 0.05
STRIP = ".,;:!?\"'()[]{}«»¿¡"


def tokens(text: str | None) -> list[str]:
    return [w.strip(STRIP) for w in text.lower().split()] if text else []


def keys(word: str) -> list[str]:
    """What a word's ratio is estimated by, from the least to the most special: prefixes, then itself."""
    return [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n] + [f"={word}"]


def bucket(key: str) -> int:
    return crc32(key.encode()) % BUCKETS


class Ratios:
    """Ratio of a key's rates in toxic and clean text, with a prior ratio that weighs PRIOR tokens.

    All keys are counted, in buckets of a fixed number: the table has the same size for any vocabulary, and a key that the
    fit has not seen leaves its prior as it is (unless it shares a bucket).
    """

    def __init__(self, toxic: np.ndarray, clean: np.ndarray):
        """Counts by bucket; those of clean text are scaled to the number of tokens of toxic text."""
        self.toxic, self.clean = toxic, clean

    def get(self, key: str, prior: float) -> float:
        b = bucket(key)
        return (float(self.toxic[b]) + PRIOR * prior) / (float(self.clean[b]) + PRIOR)


class Scores(dict):
    """Score of each word: log ratio of its rates in toxic and clean text, each estimate with the one before as its
    Dirichlet prior, less the drift. Words are remembered up to a bound."""

    def __init__(self, ratios: Ratios):
        self.ratios = ratios

    def __missing__(self, word: str) -> float:
        ratio = 1.0
        for k in keys(word):
            ratio = self.ratios.get(k, ratio)
        if len(self) > 500_000:
            self.clear()
        self[word] = value = log(ratio) - DRIFT
        return value


def segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score): disjoint, found in one pass in linear time.

    Each candidate keeps the cumulative sums at its ends and a link to the nearest one before it whose left sum is lower,
    so that a search backwards skips what earlier searches have passed.
    """
    start: list[int] = []
    stop: list[int] = []
    left: list[float] = []
    right: list[float] = []
    link: list[int] = []
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        a, b, lo, hi = i, i + 1, before, total
        while True:
            j = len(start) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                start.append(a), stop.append(b), left.append(lo), right.append(hi), link.append(j)
                break
            a, lo = start[j], left[j]
            for x in (start, stop, left, right, link):
                del x[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in zip(start, stop, left, right)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _shape(best: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(best, -10, 40), np.log1p(np.maximum(high, 0))])


def fit_extreme(n: np.ndarray, s: np.ndarray) -> tuple[float, float]:
    """lam and k of P(best score < s) = exp(-k n exp(-lam s)) from clean texts' lengths and best scores: the likeliest on a
    grid, without the highest twentieth (some labels are wrong)."""
    low = s <= np.quantile(s, 0.95)
    n, s = n[low], s[low]
    best = (-np.inf, 1.0, 1.0)
    for lam in np.geomspace(0.1, 10, 120):
        e = n * np.exp(-lam * s)
        k = len(s) / e.sum()
        best = max(best, (float(np.sum(np.log(k * lam * n) - lam * s - k * e)), float(lam), float(k)))
    return best[1:]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _count(batches):
    sums = np.zeros((2, BUCKETS + 1), np.int64)  # the last place counts tokens
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for w, n in Counter(tokens(text)).items():
                sums[y, BUCKETS] += n
                for k in keys(w):
                    sums[y, bucket(k)] += n
    at = np.flatnonzero(sums.any(axis=0))
    for a in range(0, len(at), 50_000):
        part = at[a : a + 50_000]
        yield pa.RecordBatch.from_pydict({"bucket": part.astype(np.int32), "t": sums[1, part], "c": sums[0, part]})


def evidence(values: list[float], lam: float, k: float) -> tuple[list, float, float]:
    """The significant segments of a text's word scores, the evidence of its best segment, and that of all significant ones."""
    cut = log(k * max(1, len(values)))
    all_ = [(x, lam * x[2] - cut) for x in segments(values)]
    high = [x for x in all_ if x[1] >= -log(SIGNIFICANT)]
    return [x for x, _ in high], max((e for _, e in all_), default=-cut), float(sum(e for _, e in high))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> dict | None:
    """The model, from labelled rows that are not held out: up to `train_rows` of each class by hash of the id.

    Three quarters of them give the counts of words and prefixes, the rest (not seen by the counts) the extreme-value law of
    clean texts' best segments and the logistic curve from evidence to probability, weighted to the labels' true shares.
    The driver receives BUCKETS counts at most and some numbers for each row of that quarter. Labels other than 0 and 1
    are left out, a document with several labels is toxic if one of them says so, and repeated documents count each. Null
    and empty texts have no words; texts of any length are taken whole. None without rows of both classes.
    """
    spark = docs.sparkSession
    lab = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1) and l_id is not null").filter(~held_out(F.col("l_id")))
    lab = lab.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    shares = {r[0]: r[1] for r in lab.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return None
    picked = [lab.filter(F.col("toxic") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumn("fit", F.pmod(F.xxhash64("l_id", F.lit(1)), F.lit(4)) > 0)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = d.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("text", "toxic", "fit")  # 2 x train_rows ids
    counted = rows.filter("fit").select("text", "toxic").mapInArrow(_count, "bucket int, t long, c long")
    found = counted.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toArrow()
    counts = np.zeros((2, BUCKETS + 1))
    counts[:, found["bucket"].to_numpy()] = found["t"].to_numpy(), found["c"].to_numpy()
    scale = counts[0, BUCKETS] / (counts[1, BUCKETS] or 1) or 1.0
    ratios = Ratios(counts[0, :BUCKETS].astype(np.float32), (counts[1, :BUCKETS] * scale).astype(np.float32))
    shared = spark.sparkContext.broadcast(ratios)  # 16 MB

    def best(batches):
        scores = Scores(shared.value)
        for batch in batches:
            found = [[scores[w] for w in tokens(t)] for t in batch.column("text").to_pylist()]
            tops = [max((x[2] for x in segments(v)), default=0.0) for v in found]
            yield pa.RecordBatch.from_pydict({"n": [len(v) for v in found], "s": tops, "toxic": batch.column("toxic")}, pa.schema([("n", pa.int64()), ("s", pa.float64()), ("toxic", pa.int32())]))

    calibration = rows.filter(~F.col("fit")).select("text", "toxic")
    seen = calibration.mapInArrow(best, "n long, s double, toxic int").collect()
    if len({r["toxic"] for r in seen}) < 2:
        return None
    n, s, y = (np.array([r[c] for r in seen], float) for c in ("n", "s", "toxic"))
    lam, k = fit_extreme(np.maximum(n, 1)[y == 0], s[y == 0])
    model = {"ratios": shared, "lam": lam, "k": k}

    def features(batches):
        scores = Scores(shared.value)
        for batch in batches:
            found = [evidence([scores[w] for w in tokens(t)], lam, k)[1:] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"best": [b for b, _ in found], "high": [h for _, h in found], "toxic": batch.column("toxic")}, pa.schema([("best", pa.float64()), ("high", pa.float64()), ("toxic", pa.int32())]))

    # a second pass, as a segment's evidence needs the law; the curve is fitted on what score() computes
    again = calibration.mapInArrow(features, "best double, high double, toxic int").collect()
    top, high, y = (np.array([r[c] for r in again], float) for c in ("best", "high", "toxic"))
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum()) * len(y) / sum(shares.values())
    model["beta"] = fit_logistic(_shape(top, high), y, weight)
    return model


def score(docs: DataFrame, model: dict | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments, segments (start, end, score; word offsets of significant passages).

    Null and empty texts have no segment and get the score of that; texts of any length are scored whole. Without a model
    all scores are 0. Repeated rows are scored each, and an empty table gives no rows. A null id is not held out. Labels,
    language, source and any other columns are not looked at, so their names can't clash.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, n_segments int, segments array<struct<start:int,stop:int,score:double>>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        scores = Scores(model["ratios"].value) if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            probability, found = np.zeros(len(texts)), [[] for _ in texts]
            if model:
                base = []
                for i, t in enumerate(texts):
                    high, *feature = evidence([scores[w] for w in tokens(t)], model["lam"], model["k"])
                    found[i] = [{"start": a, "stop": b, "score": s} for a, b, s in high]
                    base.append(feature)
                x = np.array(base, float)
                probability = _sigmoid(np.column_stack([np.ones(len(x)), _shape(x[:, 0], x[:, 1])]) @ model["beta"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability), pa.array([len(f) for f in found], pa.int32()), pa.array(found, spans)], ["doc_id", "score", "n_segments", "segments"])

    out = d.mapInArrow(run, schema)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "segments")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("segments")
