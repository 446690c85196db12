"""Shared pieces of the corpus operators: input, scratch tables, word patterns."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; GAP is what stands between words.
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, gap: str = GAP) -> Column:
    """Array of the words of a text, in order; a null text has none. Splitting at gaps is three times as fast as
    extracting words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts that are all ASCII go the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key from a row's id and text: repeated rows share it, and rows that differ don't."""
    text = F.coalesce(text, F.lit(""))
    return F.concat_ws(":", doc_id.cast("string"), F.xxhash64(text).cast("string"), F.hash(text).cast("string"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a session whose tasks all run in the driver's own process may
    leave it unset, as in tests, and gets a temporary folder; elsewhere executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: a cut of the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def counted(df: DataFrame) -> DataFrame:
    """As materialize(), with its rows counted while they are written: rows_of() knows them without a job."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    out._rows = seen.get.get("n", 0)
    return out


def rows_of(table: DataFrame) -> int:
    return table._rows if hasattr(table, "_rows") else table.count()


def thin(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """At most as many partitions as so many rows need, whatever number the session shuffles into."""
    return df.coalesce(rows // each + 1)


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str, name: str | None = None) -> list[str]:
    """Names in a folder of whatever store it is in (all, or just one); none if there is no such folder."""
    at, fs = _files(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return [f for f in found if name in (None, f)]


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, fs = _files(spark, path)
        fs.delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialized tables that no plan yet to run reads."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df._scratch)


def release(spark: SparkSession) -> None:
    """Lets go of what ended plans have left on the executors' disks: Spark deletes a shuffle's files once the driver has
    collected the objects that stand for it, which a long job on a quiet driver may put off for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a lookup table (keys, terms: some 100 bytes each) that small() marks for broadcast at most.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if a count shows that it has few rows; larger ones are joined by a shuffle."""
    if hasattr(df, "_rows"):
        return F.broadcast(df) if df._rows <= rows else df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of all columns) and key: no name of a column of docs can clash with another."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(docs[id_col], docs[text_col]).alias("key"))


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose key isn't in keys(key), with their columns."""
    return keyed(docs, id_col, text_col).join(small(keys.distinct()), "key", "left_anti").select("row.*")
