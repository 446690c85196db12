"""Vectors: distance, search by vector, similar symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in doubles; infinite for empty vectors or unequal lengths, 1 where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), F.lit(float("inf"))).when(norms == 0, 1.0).otherwise(1 - dot(a, b) / F.when(norms != 0, norms))


def nearest(embeddings: DataFrame, query: DataFrame, limit: int = 10) -> DataFrame:
    """symbol_id, distance of the vectors nearest to the one row of query(q). The one row is broadcast."""
    near = embeddings.crossJoin(F.broadcast(query.select("q").limit(1))).select("symbol_id", cosine_distance(F.col("embedding"), F.col("q")).alias("distance"))
    return near.orderBy("distance", "symbol_id").limit(limit)


def semantic(embeddings: DataFrame, symbols: DataFrame, files: DataFrame, vector: list[float], limit: int = 10) -> DataFrame:
    """The symbols whose vectors are nearest to a query's."""
    if embeddings.isEmpty():
        raise LookupError("there are no embeddings")
    query = embeddings.sparkSession.range(1).select(F.array(*[F.lit(float(v)) for v in vector]).alias("q"))
    return with_symbols(nearest(embeddings, query, limit), symbols, files)


def with_symbols(near: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    s = symbols.select(F.col("id").alias("symbol_id"), "file_id", "name", "kind", "line_start", "line_end")
    return near.join(s, "symbol_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("symbol_id", "name", "kind", "path", "line_start", "line_end", "distance").orderBy("distance", "symbol_id")


def similar(embeddings: DataFrame, symbols: DataFrame, files: DataFrame, name: str, path: str | None = None, limit: int = 5) -> DataFrame:
    """The symbols nearest to the first symbol of a name that has a vector, without itself."""
    of = symbols.filter(F.col("name") == name)
    if path:
        of = of.join(files.filter(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    one = embeddings.join(of.select(F.col("id").alias("symbol_id")), "symbol_id").agg(F.min_by("embedding", "symbol_id").alias("q"), F.min("symbol_id").alias("self"))
    near = embeddings.crossJoin(F.broadcast(one)).filter(F.col("symbol_id") != F.col("self"))
    near = near.select("symbol_id", cosine_distance(F.col("embedding"), F.col("q")).alias("distance")).orderBy("distance", "symbol_id").limit(limit)
    return with_symbols(near, symbols, files)
