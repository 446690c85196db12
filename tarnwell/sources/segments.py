"""Tables at rest that change by batches: a batch adds rows and buries keys, and counts once its mark is there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources.store import BROADCAST_ROWS

class Segments:
    """Named tables (schema and key columns each) below a folder.

    Batch n writes what it adds to <name>/rows-<n> (each row with `born` = n) and the keys that it ends to <name>/dead-<n>
    (key and born of the rows that go). A row lives if no batch has buried its key and born. Files are never changed: a
    batch is visible once commits/<n> is there, which names the folders in use, and what a batch that was cut off has left
    is written over. A reader thus sees a whole version, and a change costs what it changes. merge() writes the living rows
    anew, and the folders that a version before the last used go with the next merge. Tables in `laid` are split by ranges of
    the named columns and sorted by them, in each batch and merge; those in `within` are sorted by them where their rows are.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]], laid: dict[str, list[str]] | None = None, within: dict[str, list[str]] | None = None):
        self.spark, self.path, self.tables, self.laid, self.within = spark, path.rstrip("/"), tables, laid or {}, within or {}
        self._sizes: dict[str, int] = {}

    # --- marks
    def _at(self, *below: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *below)))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        at, fs = self._at("commits")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def mark(self, version: int | None = None) -> dict:
        """What a version (else the last) uses: folders and rows by table."""
        version = self.version() if version is None else version
        if not version:
            return {n: {"rows": [], "dead": [], "n_rows": 0, "n_dead": 0, "added": 0, "buried": 0} for n in self.tables}
        at, fs = self._at("commits", str(version))
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, mark: dict) -> None:
        tmp, fs = self._at("commits", f".{version}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()
        if not fs.rename(tmp, self._at("commits", str(version))[0]):
            raise RuntimeError(f"version {version} was committed by another writer")

    # --- reading
    def _parquet(self, schema: str, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(schema)
        return read.parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _dead(self, name: str, mark: dict) -> DataFrame:
        schema, key = self.tables[name]
        kinds = dict(f.split(" ", 1) for f in schema.split(", "))
        dead = self._parquet(", ".join(f"{k} {kinds[k]}" for k in key) + ", born int", mark[name]["dead"])
        return F.broadcast(dead) if mark[name]["n_dead"] <= BROADCAST_ROWS else dead

    def live(self, name: str, version: int | None = None) -> DataFrame:
        """The living rows of a table, with `born`. Columns that a query doesn't use aren't read."""
        schema, key = self.tables[name]
        mark = self.mark(version)
        rows = self._parquet(f"{schema}, born int", mark[name]["rows"])
        return rows.join(self._dead(name, mark), [*key, "born"], "left_anti") if mark[name]["dead"] else rows

    # --- writing
    def put(self, version: int, name: str, rows: DataFrame | None, dead: DataFrame | None = None) -> DataFrame:
        """Writes a table's part of a batch that is not committed yet: rows to add, and (key, born) of rows to end. Returns
        the added rows, read back."""
        schema, key = self.tables[name]
        columns = [f.split(" ", 1)[0] for f in schema.split(", ")]
        if rows is not None:
            self._write(self._lay(name, rows.select(*columns)).withColumn("born", F.lit(version)), f"{name}/rows-{version}")
        if dead is not None:
            self._write(dead.select(*key, "born").distinct(), f"{name}/dead-{version}")
        return self._parquet(f"{schema}, born int", [f"{name}/rows-{version}"] if rows is not None else [])

    def _lay(self, name: str, rows: DataFrame) -> DataFrame:
        by, within = self.laid.get(name), self.within.get(name)
        rows = rows.repartitionByRange(*by) if by else rows
        return rows.sortWithinPartitions(*(by or within)) if by or within else rows

    def _write(self, df: DataFrame, path: str) -> None:
        """Rows are counted while they are written."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/{path}")
        self._sizes[path] = seen.get.get("n", 0)

    def added(self, version: int, name: str) -> int:
        """Rows that were put for a version that is not committed yet."""
        return self._sizes.get(f"{name}/rows-{version}", 0)

    def commit(self, version: int, merged: bool = False) -> dict:
        """Makes what was put for a version count; merged: instead of all that was there before."""
        before, out = self.mark(version - 1), {}
        for name in self.tables:
            added, buried = (self._sizes.pop(f"{name}/{part}-{version}", 0) for part in ("rows", "dead"))
            last = {"rows": [], "dead": [], "n_rows": 0, "n_dead": 0} if merged else before[name]
            out[name] = {
                "rows": [*last["rows"], *([f"{name}/rows-{version}"] if added or merged else [])], "dead": [*last["dead"], *([f"{name}/dead-{version}"] if buried else [])],
                "n_rows": last["n_rows"] + added, "n_dead": last["n_dead"] + buried, "added": added, "buried": buried,
            }
        self._commit(version, out)
        return out

    def clean(self, version: int) -> None:
        """Deletes what a cut-off batch of this number has left."""
        self._sizes.clear()
        for name in self.tables:
            for part in ("rows", "dead"):
                at, fs = self._at(name, f"{part}-{version}")
                fs.delete(at, True)

    def due(self, batches: int = 64, dead: int = 10_000) -> bool:
        """Whether merging pays: a table has more dead rows than living ones (and not just a few), or batches are many."""
        return any(m["n_dead"] > dead and 2 * m["n_dead"] > m["n_rows"] or len(m["rows"]) > batches for m in self.mark().values())

    def merge(self) -> int:
        """A new version of the living rows alone; the folders that only versions before the last one used are deleted."""
        now = self.version()
        kept = {p for v in (now,) for m in self.mark(v).values() for p in (*m["rows"], *m["dead"])}
        self.clean(now + 1)
        for name in self.tables:
            self._write(self._lay(name, self.live(name, now).drop("born")).withColumn("born", F.lit(now + 1)), f"{name}/rows-{now + 1}")
        self.commit(now + 1, merged=True)
        for name in self.tables:
            at, fs = self._at(name)
            for folder in fs.listStatus(at) if fs.exists(at) else []:
                part = f"{name}/{folder.getPath().getName()}"
                if part not in kept and part != f"{name}/rows-{now + 1}":
                    fs.delete(folder.getPath(), True)
        return now + 1
