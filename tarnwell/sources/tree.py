"""Source trees as a data source that doesn't enter skipped folders and opens no file before it must."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tarnwell.sources.scan import LANGUAGES, SKIP_DIRS, detect_language, scan_tree

#: Folders that the driver looks for before it deals them out; bytes of content in a batch, unless one file is larger.
FOLDERS, CHUNK = 64, 8 << 20
LISTED = "path string, size long, mtime double, folder string"


def skipped(name: str, skip: tuple[str, ...], joined: bool = False) -> bool:
    """Whether a folder or file of this name is skipped: by its name, `*.x` by ending, and with `joined` also if `-` or `_`
    and more follow the name."""
    return any(name == s or s.startswith("*") and name.endswith(s[1:]) or joined and name.startswith((s + "-", s + "_")) for s in skip)


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))
    return store, base.rstrip("/")


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.deep = deep


class TreeReader(DataSourceReader):
    """Partitions are folders: the driver lists level by level until there are enough, and each task walks on below its own."""

    def __init__(self, options: dict):
        self.root = options["root"]
        self.skip = tuple(x for x in options.get("skip", ",".join(SKIP_DIRS)).split(",") if x)
        self.suffixes = tuple("." + x for x in options.get("suffixes", ",".join(LANGUAGES)).lower().split(",") if x)
        self.joined = options.get("joined", "false") == "true"
        self.folders = int(options.get("folders", FOLDERS))

    def _entries(self, store: fs.FileSystem, path: str) -> tuple[list[fs.FileInfo], list[str]]:
        """(files that are wanted, folders that are entered) right below a folder."""
        files, folders = [], []
        for x in store.get_file_info(fs.FileSelector(path, recursive=False)):
            if x.type == fs.FileType.Directory:
                if not skipped(x.base_name, self.skip, self.joined):
                    folders.append(x.path)
            elif not self.suffixes or x.base_name.lower().endswith(self.suffixes):
                if not (self.joined and skipped(x.base_name, self.skip, True)):
                    files.append(x)
        return files, sorted(folders)

    def partitions(self) -> list[InputPartition]:
        store, base = open_root(self.root)
        level, out = [base], []
        while level and len(level) < self.folders:
            out += [Folder(p, False) for p in level]
            level = [f for p in level for f in self._entries(store, p)[1]]
        return out + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, base = open_root(self.root)
        todo = [partition.value]
        while todo:
            folder = todo.pop()
            files, below = self._entries(store, folder)
            yield from ((x.path[len(base) + 1 :], x.size, x.mtime.timestamp() if x.mtime else 0.0, folder[len(base) + 1 :]) for x in files)
            if partition.deep:
                todo += below


class TreeSource(DataSource):
    """format("tree"): path (below root), size, mtime and folder of the files of a tree. Options: root, skip and suffixes
    (comma lists; an empty list for none), joined (skip `name-…` and `name_…` too), folders."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)


def listing(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIP_DIRS, suffixes: tuple[str, ...] = tuple(LANGUAGES), joined: bool = False, folders: int = FOLDERS) -> DataFrame:
    """path, size, mtime, folder of a tree's files; a skipped folder isn't listed, and no file is opened. The root must be in
    a store that every executor reaches by the same name."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(root=root, skip=",".join(skip), suffixes=",".join(suffixes), joined=str(joined).lower(), folders=folders).load()


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files(path, ...) with hash and content: only now are these files opened, a batch of bounded size at a time. A file that
    has gone meanwhile is left out; bytes that are no UTF-8 are replaced."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", hash string, content string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)

        def batch(rows: pa.RecordBatch, at: list[int], raw: list[bytes]) -> pa.RecordBatch:
            kept = rows.take(pa.array(at, pa.int64()))
            more = [pa.array([hashlib.md5(x).hexdigest() for x in raw], pa.string()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())]
            return pa.RecordBatch.from_arrays([*kept.columns, *more], [*kept.schema.names, "hash", "content"])

        for rows in batches:
            at, raw, size = [], [], 0
            for k, path in enumerate(rows.column("path").to_pylist()):
                try:
                    with store.open_input_stream(f"{base}/{path}") as f:
                        raw.append(f.read())
                except FileNotFoundError:
                    continue
                at.append(k)
                size += len(raw[-1])
                if size >= CHUNK:
                    yield batch(rows, at, raw)
                    at, raw, size = [], [], 0
            if at:
                yield batch(rows, at, raw)

    return files.mapInArrow(read, schema)


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """path, lang, mtime, hash, content of all source files of a tree. A store that only Spark reaches is read as a whole."""
    try:
        open_root(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return scan_tree(spark, root, skip)
    files = with_content(listing(spark, root, skip), root)
    return files.select("path", detect_language(F.col("path")).alias("lang"), "mtime", "hash", "content")
