"""Texts of symbols and their vectors."""

from __future__ import annotations

import hashlib
import re
import threading
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources.segments import Segments
from tarnwell.sources.store import steps, written

MODEL, DIMENSIONS = "hashed-tokens-384", 384
DOC_LINES, BODY_LINES = 15, 5
EMBEDDED = ("function", "class", "method")


@lru_cache(1 << 16)
def _place(word: str) -> tuple[int, float]:
    """Where a word counts, and its sign."""
    h = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little")
    return h % DIMENSIONS, 1.0 if h >> 63 else -1.0


def _encoded(text: str | None) -> np.ndarray | None:
    out = np.zeros(DIMENSIONS)
    for w in re.findall(r"[A-Za-z][a-z]+|[A-Z]+|\d+", text or ""):
        at, sign = _place(w)
        out[at] += sign
    norm = np.linalg.norm(out)
    return (out / norm).astype(np.float32) if norm else None


def encode(text: str) -> list[float] | None:
    """A unit vector of hashed tokens: the same wherever it is computed, without a model file. None for a text without words."""
    out = _encoded(text)
    return None if out is None else out.tolist()


def encode_column(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(_encoded)

    return run(text)


def symbol_text(kind: Column, name: Column, docstring: Column, lines: Column) -> Column:
    """`kind name`, up to 15 lines of the docstring and the five lines behind the header, joined by blanks."""
    doc = F.array_join(F.slice(F.split(docstring, "\n"), 1, DOC_LINES), " ")
    body = F.array_join(F.slice(lines, 2, BODY_LINES), " ")
    return F.trim(F.regexp_replace(F.concat_ws(" ", kind, name, doc, body), r"\s+", " "))


def symbol_texts(index, done: DataFrame | None = None) -> DataFrame:
    """symbol_id, text of functions, classes and methods that have no vector yet."""
    s = index.symbols.filter(F.col("kind").isin(*EMBEDDED))
    if done is not None:
        s = s.join(done.select(F.col("symbol_id").alias("id")), "id", "left_anti")
    li = index.lines.select(F.col("file_id").alias("l_file"), "line_no", "text")
    near = s.join(li, (F.col("file_id") == F.col("l_file")) & F.col("line_no").between(F.col("line_start"), F.least("line_end", F.col("line_start") + BODY_LINES)), "left")
    # by the file too, by which rows are already dealt out
    kept = F.collect_list(F.when(F.col("line_no").isNotNull(), F.struct("line_no", "text")))
    lines = near.groupBy("file_id", "id").agg(F.first("kind").alias("kind"), F.first("name").alias("name"), F.transform(F.sort_array(kept), lambda x: x["text"]).alias("lines"))
    docs = index.docstrings.select(F.col("symbol_id").alias("id"), "content").dropDuplicates(["id"])
    return lines.join(docs, "id", "left").select(F.col("id").alias("symbol_id"), symbol_text(F.col("kind"), F.col("name"), F.col("content"), F.col("lines")).alias("text"))


def embed_symbols(index, done: DataFrame | None = None) -> DataFrame:
    """Vectors of functions, classes and methods that have none yet."""
    return symbol_texts(index, done).select("symbol_id", encode_column(F.col("text")).alias("embedding"), F.lit(MODEL).alias("model"))


VECTORS = ("symbol_id long, embedding array<float>, model string", ["symbol_id"])


class EmbeddingJob:
    """Vectors at rest, made slice by slice. Each slice is committed when it is done, so a run that was stopped or has failed
    goes on with the symbols that have no vector. stop() may come from another thread: it cancels what runs just now."""

    def __init__(self, spark: SparkSession, path: str, slices: int = 16):
        self.spark, self.slices, self.at = spark, slices, Segments(spark, path, {"embeddings": VECTORS})
        self.tag, self._stopped = f"embedding-{uuid.uuid4().hex}", threading.Event()
        self.state = {"enabled": True, "running": False, "model": MODEL, "total": 0, "done": 0, "error": None}

    def vectors(self) -> DataFrame:
        return self.at.live("embeddings").drop("born")

    def status(self) -> dict:
        """Whether it runs, how many symbols there are and how many have a vector, and the last error."""
        mark = self.at.mark()["embeddings"]
        return self.state | {"done": mark["n_rows"] - mark["n_dead"]}

    def enable(self, on: bool) -> dict:
        self.state["enabled"] = on
        return self.status()

    def stop(self) -> None:
        self._stopped.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, index, after: Callable[[dict], None] | None = None) -> dict:
        """Makes the vectors that are missing; `after` is told the status after each slice. Vectors of symbols that are gone
        are taken out first. The texts of all symbols that lack a vector are put together once, and slices read theirs."""
        if not self.state["enabled"]:
            return self.status()
        self._stopped.clear()
        self.state |= {"running": True, "error": None}
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            wanted = index.symbols.filter(F.col("kind").isin(*EMBEDDED)).select(F.col("id").alias("symbol_id"))
            self.state["total"] = wanted.count()
            n = self.at.version() + 1
            self.at.clean(n)
            self.at.put(n, "embeddings", None, self.at.live("embeddings").select("symbol_id", "born").join(wanted, "symbol_id", "left_anti"))
            self.at.commit(n)
            with steps(self.spark):
                texts = written(symbol_texts(index, self.vectors()).withColumn("slice", F.pmod(F.xxhash64("symbol_id"), F.lit(self.slices))))
                for k in range(self.slices):
                    if self._stopped.is_set():
                        break
                    n = self.at.version() + 1
                    self.at.clean(n)
                    part = texts.filter(F.col("slice") == k)
                    self.at.put(n, "embeddings", part.select("symbol_id", encode_column(F.col("text")).alias("embedding"), F.lit(MODEL).alias("model")))
                    self.at.commit(n)
                    if after:
                        after(self.status())
        except Exception as e:
            if not self._stopped.is_set():  # what stop() cancels is no error
                self.state["error"] = f"{type(e).__name__}: {e}"[:500]
                raise
        finally:
            context.removeJobTag(self.tag)
            self.state["running"] = False
        return self.status()
