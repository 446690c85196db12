"""Streams with keyed state: the newest row of each key, and a log that new readers get from its tail on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lines of a log that a new reader gets.
RING = 500


@contextmanager
def rocksdb(spark: SparkSession):
    """A query that starts inside keeps its state in RocksDB; the session's own setting holds again afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _place(row: tuple, at: list[int]) -> tuple:
    """What rows of a key are ordered by: the order columns, nulls first, then the rest, so that ties don't matter."""
    rest = [k for k in range(len(row)) if k not in at]
    plain = lambda x: (False, "") if x is None else (True, x)
    return tuple(plain(row[k]) for k in at), tuple(str(plain(row[k])) for k in rest)


class Newest(StatefulProcessor):
    """Keeps one row a key, and emits it when another takes its place. A row that comes late loses by its order."""

    def __init__(self, schema: str, order: list[int], ttl_ms: int | None):
        self.schema, self.order, self.ttl = schema, order, ttl_ms
        self.columns = [f.split(" ", 1)[0].strip("`") for f in schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", self.schema, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        best = held
        for row in map(tuple, rows):
            if best is None or _place(row, self.order) > _place(best, self.order):
                best = row
        if best is not held:
            self.state.update(best)
            yield Row(**dict(zip(self.columns, best)))

    def close(self) -> None:
        pass


def newest(source: DataFrame, key: str, order: tuple[str, ...], ttl_ms: int | None = None) -> DataFrame:
    """The newest row of each key of a stream, emitted whenever it changes (update mode).

    One row a key is held, in the state store, and a batch costs what it brings: nothing is read or written for other keys.
    Of a key's rows in an Arrow batch the newest goes on alone, so a busy key sends few rows to its task. With ttl_ms a key
    that hasn't changed for so long is forgotten.
    """
    columns, at = source.columns, [source.columns.index(c) for c in order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    k = columns.index(key)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict = {}
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            for i, row in enumerate(rows):
                if row[k] not in best or _place(row, at) > _place(rows[best[row[k]]], at):
                    best[row[k]] = i
            yield batch.take(pa.array(list(best.values()), pa.int64()))

    first = source.mapInArrow(ahead, source.schema)
    return first.groupBy(key).transformWithState(Newest(schema, at, ttl_ms), outputStructType=source.schema, outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime")


def keep_newest(source: DataFrame, key: str, order: tuple[str, ...], checkpoint: str, ttl_ms: int | None = None):
    """Starts a run over all that is there; the checkpoint holds the state, from which a next run goes on."""
    with rocksdb(source.sparkSession):
        return newest(source, key, order, ttl_ms).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held(spark: SparkSession, checkpoint: str, state: str = "newest") -> DataFrame:
    """The rows that the state of a run holds, read from its checkpoint."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", state).load().select("value.*")


def state_rows(run) -> int:
    """Keys that a run's state holds."""
    done = [p for p in run.recentProgress if p["stateOperators"]]
    return sum(o["numRowsTotal"] for o in done[-1]["stateOperators"]) if done else 0


EVENT = "log string, at long, reader string, text string"
SENT = "reader string, log string, at long, text string, live boolean"


class Ring(StatefulProcessor):
    """The last lines of a log and its readers. A reader that joins gets the lines that are held, and then each new one."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "at long, text string")
        self.readers = handle.getListState("readers", "reader string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = sorted(((r["at"], r["reader"], r["text"]) for r in rows), key=lambda r: (r[0], r[1] is not None, str(r[1]), str(r[2])))
        lines = [tuple(x) for x in self.lines.get()]
        readers = [x[0] for x in self.readers.get()]
        sent = lambda reader, at, text, live: Row(reader=reader, log=key[0], at=at, text=text, live=live)
        for at, reader, text in events:
            if reader is None:
                lines = [*lines, (at, text)][-self.size :]
                yield from (sent(r, at, text, True) for r in readers)
            elif reader not in readers:
                readers.append(reader)
                yield from (sent(reader, *line, False) for line in lines)
        for state, rows in ((self.lines, lines), (self.readers, [(r,) for r in readers])):
            if rows:
                state.put(rows)

    def close(self) -> None:
        pass


def follow(events: DataFrame, size: int = RING) -> DataFrame:
    """events(log, at, reader, text): a line of a log (no reader), or a reader that joins it (no text). Gives what is sent to
    each reader: the last `size` lines from before it joined (live false), then each line that comes after (live true).

    A log's ring and readers are the state of one key. Events of a batch are taken by `at`, of one moment lines first; a
    line that comes late stands where it came. Joining twice changes nothing.
    """
    return events.select("log", "at", "reader", "text").groupBy("log").transformWithState(Ring(size), outputStructType=SENT, outputMode="Append", timeMode="None")


def run_follow(events: DataFrame, out: str, checkpoint: str, size: int = RING):
    """Starts a run that writes what is sent to a Parquet table."""
    with rocksdb(events.sparkSession):
        return follow(events, size).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
