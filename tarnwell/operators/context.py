"""What stands around an error, and where a snippet comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.functions import extract
from tarnwell.functions.blocks import language
from tarnwell.operators.graph import edge_view
from tarnwell.operators.symbols import rank, with_source

# Keywords that name nothing.
STOPWORDS = ("self", "None", "True", "False", "return", "def", "class", "import", "from", "async", "await", "for", "if", "else")
# End of fixed values.
TYPES_PER_TOKEN, CALLERS = 5, 10


def enclosing(symbols: DataFrame, files: DataFrame, path: str, line: int) -> DataFrame:
    """The smallest symbol around a line of a file."""
    own = symbols.join(files.filter(F.col("path") == path).select(F.col("id").alias("file_id"), "path"), "file_id")
    return own.filter((F.col("line_start") <= line) & (F.col("line_end") >= line)).orderBy(F.col("line_end") - F.col("line_start"), "id").limit(1)


def tokens(spark, message: str, line: DataFrame) -> DataFrame:
    """Names in a message and a source line, each once, without stopwords."""
    text = line.agg(F.concat_ws(" ", F.lit(message), F.max("text")).alias("t"))
    names = F.array_except(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\b([A-Za-z_]\w{2,})\b"), F.lit(1))), F.array(*map(F.lit, STOPWORDS)))
    return text.select(F.explode(names).alias("token"))


def error_context(index, message: str, path: str, line: int) -> dict[str, DataFrame]:
    """function (with source), line, types (up to five a token), imports, and up to ten callers of the function by id."""
    spark = index.files.sparkSession
    one = enclosing(index.symbols, index.files, path, line)
    at = index.lines.join(index.files.filter(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id").filter(F.col("line_no") == line).select("text")
    hints = index.type_hints.join(index.symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id").join(tokens(spark, message, at).withColumnRenamed("token", "name"), "name")
    place = F.row_number().over(W.partitionBy("name").orderBy("symbol_id", "param_name"))
    types = hints.withColumn("place", place).filter(F.col("place") <= TYPES_PER_TOKEN).select("name", "param_name", "annotation", "is_return").orderBy("name", "param_name")
    imports = index.imports.join(index.files.filter(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id").select("module").orderBy("module")
    callers = edge_view(index).join(one.select(F.col("id").alias("callee_id")), "callee_id").select("caller_name", "caller_file", "caller_line").orderBy("caller_file", "caller_line", "caller_name").limit(CALLERS)
    return {"function": with_source(one, index.lines), "line": at, "types": types, "imports": imports, "callers": callers}


def detect_original(index, code: str, hint: str | None = None, lang: str | None = None, limit: int = 5) -> DataFrame:
    """Symbols that a snippet's first definition may be an edit of, best first, with their source: of its kind (a method may
    be a function), else of any; paths that hold the hint, or are held by it, come first."""
    lang = language(hint, lang)
    rows = sorted((r[3], r[2], r[1]) for r in extract.facts(code, lang) if r[0] == "symbol")
    if not rows:
        raise ValueError("the snippet defines nothing")
    _, kind, name = rows[0]
    near = F.lit(1)
    if hint:
        path = F.lower("path")
        near = F.when(F.contains(path, F.lit(hint.lower())) | F.contains(F.lit(hint.lower()), path), 0).otherwise(1)
    kinds = F.when(F.col("kind") == kind, 0).when((F.lit(kind) == "method") & (F.col("kind") == "function"), 1).otherwise(2)
    found = index.symbols.filter(F.col("name").ilike(f"%{name}%")).join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    found = found.select("*", rank(F.col("name"), name).alias("rank"), kinds.alias("kind_rank"), near.alias("near")).orderBy("rank", "kind_rank", "near", "path", "line_start").limit(limit)
    return with_source(found, index.lines).orderBy("rank", "kind_rank", "near", "path", "line_start")
