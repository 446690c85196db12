"""Names to symbols: enclosing symbols, qualified names, call resolution, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def is_call_name(name: Column) -> Column:
    """Capitalised callees are taken for constructors and left out."""
    return ~F.regexp_like(name, F.lit(r"^\p{Lu}"))


def dotted_path(path: Column, lang: Column) -> Column:
    """A path without suffix in dot notation; a Python package's own file stands for the package."""
    plain = F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    return F.when(lang == "python", F.regexp_replace(plain, r"\.__init__$", "")).otherwise(plain)


def qualified_name(path: Column, lang: Column, name: Column) -> Column:
    return F.concat(dotted_path(path, lang), F.lit("."), name)


def enclosing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points(file_id, line, ...) with caller_id, the smallest symbol around the line; points outside all are dropped.

    A symbol is laid out over its lines, so that the join is on (file_id, line) and grows with nesting depth times lines,
    and not with lines times symbols of a file.
    """
    cover = symbols.select("file_id", F.explode(F.sequence("line_start", "line_end")).alias("line"), F.struct((F.col("line_end") - F.col("line_start")).alias("size"), F.col("id").alias("id")).alias("s"))
    inner = cover.groupBy("file_id", "line").agg(F.min("s").alias("s"))
    return points.join(inner, ["file_id", "line"]).withColumn("caller_id", F.col("s.id")).drop("s")


def resolve_callees(calls: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Edges of calls(file_id, line, pos, callee_name, caller_id): a symbol of that name in the same file (nearest to the
    caller), else one under an imported module (shortest qualified name), else the only one of that name, else null. keep:
    columns of calls that the edges are to have too."""
    one = ["file_id", "line", "pos"]
    own = symbols.select("file_id", F.col("name").alias("callee_name"), F.col("id").alias("id"), "line_start")
    start = symbols.select(F.col("id").alias("caller_id"), F.col("line_start").alias("from_line"))
    near = calls.join(start, "caller_id").join(own, ["file_id", "callee_name"])
    near = near.groupBy(*one).agg(F.min(F.struct(F.abs(F.col("line_start") - F.col("from_line")), "id")).alias("s")).select(*one, F.col("s.id").alias("id_1"))
    # imports meet what their modules define before they meet calls, so no call meets all imports of its file
    dot = F.instr(F.reverse("qualified_name"), ".")
    full = symbols.filter(dot > 0).select(F.expr("left(qualified_name, length(qualified_name) - instr(reverse(qualified_name), '.'))").alias("module"), F.substring_index("qualified_name", ".", -1).alias("callee_name"), F.struct(F.length("qualified_name").alias("size"), "id").alias("s"))
    offered = imports.select("file_id", "module").distinct().join(full, "module").groupBy("file_id", "callee_name").agg(F.min("s").alias("s"))
    under = calls.select(*one, "callee_name").join(offered, ["file_id", "callee_name"]).select(*one, F.col("s.id").alias("id_2"))
    lone = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("n"), F.min("id").alias("id_3")).filter("n = 1").drop("n")
    found = calls.join(near, one, "left").join(under, one, "left").join(lone, "callee_name", "left").withColumn("callee_id", F.coalesce("id_1", "id_2", "id_3"))
    target = symbols.select(F.col("id").alias("callee_id"), F.coalesce("qualified_name", "name").alias("resolved_name"), F.col("file_id").alias("f_id"))
    target = target.join(files.select(F.col("id").alias("f_id"), F.col("path").alias("callee_file")), "f_id", "left").drop("f_id")
    return found.join(target, "callee_id", "left").select("caller_id", "callee_name", "line", "pos", "callee_id", "resolved_name", "callee_file", *keep)


def references_last(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """tokens(file_id, line, name) as references to the last symbol of their name, one row a token."""
    last = symbols.groupBy("name").agg(F.max("id").alias("symbol_id"))
    return tokens.join(last, "name").select("symbol_id", "file_id", "line")


def references_near(tokens: DataFrame, symbols: DataFrame, every: bool = False) -> DataFrame:
    """As references_last(), but a symbol of the token's own file comes first, else only a unique name counts. every: tokens
    without a symbol stay, and so does the name."""
    own = symbols.groupBy("file_id", "name").agg(F.min("id").alias("own"))
    lone = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only")).filter("n = 1").drop("n")
    found = tokens.join(own, ["file_id", "name"], "left").join(lone, "name", "left")
    found = found.withColumn("symbol_id", F.coalesce("own", "only"))
    return found.select("file_id", "line", "name", "symbol_id") if every else found.select("symbol_id", "file_id", "line").filter("symbol_id is not null")


def first_by_name(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """rows(file_id, name, ...) with symbol_id, the first symbol of that name in the file."""
    place = F.row_number().over(W.partitionBy("file_id", "name").orderBy("id"))
    first = symbols.withColumn("place", place).filter("place = 1").select("file_id", "name", F.col("id").alias("symbol_id"))
    return rows.join(first, ["file_id", "name"])
