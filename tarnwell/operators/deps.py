"""Imports: of a file, of a module, and files that import the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.paths import required


def _paths(files: DataFrame) -> DataFrame:
    return files.select(F.col("id").alias("file_id"), "path")


def file_imports(imports: DataFrame, files: DataFrame, path: str) -> DataFrame:
    required(path, "file")
    return imports.join(_paths(files).filter(F.col("path") == path), "file_id").select("module", "level", "is_star").orderBy("module")


def importers(imports: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """Files that import a module or one below it."""
    required(module, "module")
    below = (F.col("module") == module) | F.startswith("module", F.lit(module + "."))
    return imports.filter(below).join(_paths(files), "file_id").select("path", "module", "level", "is_star").orderBy("path", "module")


def co_importers(imports: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Other files that import a module which this file imports: (path, module), each once."""
    mine = imports.join(_paths(files).filter(F.col("path") == path), "file_id").select("module").distinct()
    others = imports.join(mine, "module", "left_semi").join(_paths(files), "file_id").filter(F.col("path") != path)
    return others.select("path", "module").distinct().orderBy("path", "module")


def file_deps(imports: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """One row: what a file imports and which files share an import with it."""
    own = file_imports(imports, files, path).agg(F.array_sort(F.collect_list(F.struct("module", "level", "is_star"))).alias("imports"))
    shared = co_importers(imports, files, path).agg(F.array_sort(F.collect_set("path")).alias("imported_by"))
    return own.join(shared, F.lit(True))
