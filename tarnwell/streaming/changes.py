"""Streams: the newest version of each path in a batch, index maintenance from a change log, log tails, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tarnwell.sources.ingest import Store

CHANGE = "event_id long, ts timestamp, path string, op string, dest string, content string"
TAIL = 500


def latest(rows: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest row of each key: an aggregation to a maximum, so a busy key costs no more than others."""
    row = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def settle(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes) of a batch of changes; a move is a delete and a create, and the last change of a path holds."""
    moved = F.col("op") == "moved"
    away = batch.filter(moved).select("event_id", "ts", "path", F.lit("deleted").alias("op"), F.lit(None).cast("string").alias("content"))
    there = batch.filter(moved).select("event_id", "ts", F.col("dest").alias("path"), F.lit("created").alias("op"), "content")
    rows = batch.filter(~moved).select("event_id", "ts", "path", "op", "content").unionByName(away).unionByName(there)
    last = latest(rows)
    return last.filter("op <> 'deleted'").select("path", "content"), last.filter("op = 'deleted'").select("path")


def maintain(spark: SparkSession, source: str, store: str, checkpoint: str, after: Callable[[int], None] | None = None, on_event: Callable[[dict], None] | None = None):
    """A stream over a folder of change files (Parquet, schema CHANGE) that keeps a Store up to date, batch by batch.

    A batch that is run again after a failure gives the same files and facts, as contents are compared by hash. on_event gets
    what Store tells of each batch.
    """
    at = Store(spark, store, on_event=on_event)

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        if not df.isEmpty():
            version = at.apply(*settle(df))
            if after:
                after(version)
        df.unpersist()

    rows = spark.readStream.schema(CHANGE).parquet(source)
    rows = rows.observe("changes", F.count(F.lit(1)).alias("changes"), F.count_if(F.col("op") == "deleted").alias("deletes"), F.count_if(F.col("op") == "moved").alias("moves"))
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(rows: DataFrame, order: str = "ts", n: int = TAIL) -> DataFrame:
    """The last n rows of a log, oldest first."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def progress(query) -> list[dict]:
    """What a stream has done: batches, rows and rates."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]


class Events(StreamingQueryListener):
    """Tells of streams as they run: start, progress (rows, and the numbers that the stream observes), done or error."""

    def __init__(self, on_event: Callable[[dict], None]):
        self.on_event = on_event

    def onQueryStarted(self, event):
        self.on_event({"event": "start", "run": str(event.runId)})

    def onQueryProgress(self, event):
        p = event.progress
        seen = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
        self.on_event({"event": "progress", "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, **seen})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.on_event({"event": "error", "run": str(event.runId), "message": event.exception[:500]} if event.exception else {"event": "done", "run": str(event.runId)})
