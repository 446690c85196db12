"""The code index: its relations as data frames, as views, and at rest."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from tarnwell.plans import schema as S

SCHEMAS = {
    "files": S.FILES, "lines": S.LINES, "symbols": S.SYMBOLS, "calls": S.CALLS, "call_edges": S.CALL_EDGES, "symbol_references": S.REFERENCES, "docstrings": S.DOCSTRINGS, "imports": S.IMPORTS,
    "type_hints": S.TYPE_HINTS, "embeddings": S.EMBEDDINGS, "closure": S.CLOSURE, "git_history": S.GIT_HISTORY, "edits": S.EDITS, "name_uses": S.NAME_USES, "imported_names": S.IMPORTED_NAMES, "bare_calls": S.NAME_USES, "decorated": S.NAME_USES,
}


@dataclass
class CodeIndex:
    files: DataFrame
    lines: DataFrame
    symbols: DataFrame
    calls: DataFrame
    call_edges: DataFrame
    symbol_references: DataFrame
    docstrings: DataFrame
    imports: DataFrame
    type_hints: DataFrame
    embeddings: DataFrame
    closure: DataFrame
    git_history: DataFrame
    edits: DataFrame
    name_uses: DataFrame
    imported_names: DataFrame
    bare_calls: DataFrame
    decorated: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, **given: DataFrame) -> CodeIndex:
        return cls(**{n: given.get(n) if given.get(n) is not None else spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def create_views(self, prefix: str = "") -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def save(self, path: str) -> None:
        """Overwrites the index at a path: one Parquet table a relation."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeIndex:
        return cls(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()})

    @classmethod
    def clear(cls, spark: SparkSession, path: str) -> None:
        cls.empty(spark).save(path)
