"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session whose tasks all run in the driver's own process may leave
    it unset, as in tests, and gets a temporary folder; elsewhere executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


_scopes = threading.local()


@contextmanager
def steps(spark: SparkSession):
    """Deletes the tables that written() makes inside, at the end: for work that leaves its results elsewhere."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        for path in _scopes.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _scopes.paths = outer


def written(df: DataFrame) -> DataFrame:
    """Writes a table below spark.checkpoint.dir and reads it back, so a loop's plan stays short and lost executors cost
    nothing. Inside of steps() it goes at the end of that. Its rows are counted while they are written: see rows_of()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rows = seen.get.get("n", 0)
    return out


def rows_of(table: DataFrame) -> int:
    """Rows of a table that written() has made, without a job."""
    return table._rows


#: Rows of a table of keys that is broadcast at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, of: DataFrame | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table of keys for broadcast if it has few rows: no more than `of`, a written table that it is made from, has,
    or as a count shows."""
    known = getattr(df if of is None else of, "_rows", None)
    if known is not None and known <= rows:
        return F.broadcast(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
