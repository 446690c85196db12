"""Search in lines and file names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.sources.scan import LANGUAGE_ALIASES, SEARCH_SKIP, in_skipped
from tarnwell.sources.store import BROADCAST_ROWS

PER_FILE = 20


def _hit(query: str, regex: bool) -> tuple[Column, Column]:
    """(whether a line matches, 0-based character offset of its first match)."""
    if regex:
        return F.regexp_like("text", F.lit(query)), F.length(F.element_at(F.split(F.col("text"), f"(?:{query})", 2), 1))
    return F.contains("text", F.lit(query)), F.instr("text", F.lit(query)) - 1


def search_code(lines: DataFrame, files: DataFrame, query: str, *, lang: str | None = None, limit: int = 50, context: int = 0, regex: bool = False, exclude_dirs: Sequence[str] = SEARCH_SKIP) -> DataFrame:
    """file, line, col, text (right-trimmed) and, if asked for, before and after: matching lines by path and line.

    Files below excluded folders are left out. A file gives up to min(limit, 20) matches. An unknown language is no filter. A blank query gives nothing; one with a
    line break is matched on whole files. Context is a frame over the file's lines, so neighbouring matches share it.
    """
    if not query.strip():
        return lines.select(F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), "text").limit(0)
    files = files.filter(~in_skipped(F.col("path"), exclude_dirs)) if exclude_dirs else files
    files = files.select(F.col("id").alias("file_id"), F.col("path").alias("file"), "lang")
    if lang and lang.lower() in LANGUAGE_ALIASES:
        files = files.filter(F.col("lang") == LANGUAGE_ALIASES[lang.lower()])
    if "\n" in query:
        return search_multiline(lines, files, query, limit, regex)
    match, col = _hit(query, regex)
    place = F.row_number().over(W.partitionBy("file_id").orderBy("line_no"))
    found = lines.filter(match).join(files, "file_id").withColumn("place", place).filter(F.col("place") <= min(limit, PER_FILE))
    found = found.orderBy("file", "line_no").limit(limit).select("file_id", "file", "line_no", col.alias("col"), F.rtrim("text").alias("text"))
    extra = ["before", "after"] if context else []
    if context:
        found = with_context(found, lines, context, limit * 2 * context)
    return found.orderBy("file", "line_no").select("file", F.col("line_no").alias("line"), "col", "text", *extra)


def with_context(found: DataFrame, lines: DataFrame, context: int, most: int) -> DataFrame:
    """found(file_id, line_no, ...) with before and after, the lines around each: numbers of lines that are wanted meet the
    lines by file and number, so only those are gathered. most: bounds how many."""
    near = F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context))
    wanted = found.select("file_id", "line_no", near.alias("near")).filter("near <> line_no")
    wanted = F.broadcast(wanted) if most <= BROADCAST_ROWS else wanted
    around = lines.select("file_id", F.col("line_no").alias("near"), F.col("text").alias("line")).join(wanted, ["file_id", "near"])
    around = around.groupBy("file_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("near", "line"))).alias("around"))
    side = lambda keep: F.coalesce(F.transform(F.filter("around", keep), lambda x: x["line"]), F.array().cast("array<string>"))
    out = found.join(around, ["file_id", "line_no"], "left")
    return out.withColumns({"before": side(lambda x: x["near"] < F.col("line_no")), "after": side(lambda x: x["near"] > F.col("line_no"))}).drop("around")


def search_multiline(lines: DataFrame, files: DataFrame, query: str, limit: int, regex: bool = False) -> DataFrame:
    """file, line, col, text: matches of a pattern over line breaks, by file and place, up to min(limit, 20) of a file."""
    pattern = r"\r?\n".join(p if regex else re.escape(p) for p in query.split("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    whole = lines.join(files, "file_id").groupBy("file_id", "file").agg(text.alias("text")).filter(F.regexp_like("text", F.lit(pattern)))
    whole = whole.select("file", F.split("text", f"(?:{pattern})").alias("between"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"))
    one = F.sequence(F.lit(0), F.least(F.size("hits"), F.lit(min(limit, PER_FILE))) - 1)
    ahead = lambda i: F.concat(F.array_join(F.transform(F.slice(F.arrays_zip("between", "hits"), F.lit(1), i), lambda x: F.concat(x["between"], x["hits"])), ""), F.get("between", i))
    found = whole.select("file", F.posexplode(F.transform(one, lambda i: F.struct(F.split(ahead(i), "\n").alias("before"), F.get("hits", i).alias("text")))).alias("place", "m"))
    return found.orderBy("file", "place").limit(limit).select("file", F.size("m.before").alias("line"), F.length(F.element_at("m.before", -1)).alias("col"), "m.text")


def grep_file(lines: DataFrame, files: DataFrame, path: str, pattern: str, context: int = 0) -> DataFrame:
    """All lines of one file that a regular expression matches, with context."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a regular expression: {e}") from e
    one = files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
    own = lines.join(F.broadcast(one), "file_id")
    match, col = _hit(pattern, True)
    found = own.filter(match).select("file_id", "line_no", col.alias("col"), "text")
    found = with_context(found, own, context, BROADCAST_ROWS + 1) if context else found
    return found.orderBy("line_no").select(F.col("line_no").alias("line"), "col", "text", *(["before", "after"] if context else []))


def find_file(files: DataFrame, pattern: str) -> DataFrame:
    """Paths whose file name matches: a regular expression, or a glob where that is none. Lower-case patterns match any case."""
    if not pattern or not pattern.strip():
        raise ValueError("pattern must not be empty")
    try:
        re.compile(pattern)
    except re.error:
        pattern = "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    if pattern == pattern.lower():
        pattern = "(?i)" + pattern
    return files.filter(F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(pattern))).select("path").orderBy("path")


def read_lines(lines: DataFrame, files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """line, text of an inclusive range, cut at the end of the file."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("line ranges are 1-based and inclusive")
    own = lines.join(F.broadcast(files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))), "file_id")
    own = own.filter(F.col("line_no") >= start)
    return (own if end is None else own.filter(F.col("line_no") <= end)).orderBy("line_no").select(F.col("line_no").alias("line"), "text")


def read_file(lines: DataFrame, files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """One row: the range as numbered text."""
    numbered = F.collect_list(F.struct("line", F.concat(F.col("line").cast("string"), F.lit(": "), "text").alias("t")))
    return read_lines(lines, files, path, start, end).agg(F.array_join(F.transform(F.array_sort(numbered), lambda x: x["t"]), "\n").alias("content"))


def read_scattered(lines: DataFrame, files: DataFrame, path: str, wanted: list[int]) -> DataFrame:
    """position, line, content, error for each asked line, in the order asked; lines that aren't there have an error."""
    spark = lines.sparkSession
    asked = spark.createDataFrame(list(enumerate(wanted)), "position int, line int")
    own = read_lines(lines, files, path)
    out = asked.join(own, "line", "left")
    return out.select("position", "line", F.col("text").alias("content"), F.when(F.col("text").isNull(), "out of range").alias("error")).orderBy("position")


def count_lines(lines: DataFrame) -> DataFrame:
    """Lines of each file; an empty piece behind a final line break is none."""
    last = F.max_by("text", "line_no") == ""
    return lines.groupBy("file_id").agg((F.count("*") - F.when(last, 1).otherwise(0)).alias("n_lines"))


def symbol_or_grep(lines: DataFrame, files: DataFrame, symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Rows of symbols of the bare name in a query such as `def f(x):`; where there are none, lines that define it."""
    name = re.sub(r"^\s*(def|class|function|func|fn)\s+", "", query)
    name = re.sub(r"\(.*$", "", name).strip().rstrip(":").strip()
    of = symbols.filter(F.col("name") == name).join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id").select("file", F.col("line_start").alias("line"), F.col("name").alias("text"))
    grep = search_code(lines, files, rf"\b(def|class)\s+{re.escape(name)}\b", limit=limit, regex=True).select("file", "line", "text")
    none = of.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return of.unionByName(grep.join(F.broadcast(none), F.lit(True)).drop("n")).orderBy("file", "line").limit(limit)
