"""Tool output as rows: linters, compilers and test runs, by native functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ("file", "line", "col", "severity", "code", "message")


def _lines(raw: DataFrame, column: str) -> DataFrame:
    return raw.select("id", F.posexplode(F.split(column, "\r?\n")).alias("pos", "line"))


def _rows(df: DataFrame, file: Column, line: Column, col: Column, severity: Column, code: Column, message: Column) -> DataFrame:
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0)) if c is not None else F.lit(0)
    return df.select("id", "pos", file.alias("file"), number(line).alias("line"), number(col).alias("col"), severity.alias("severity"), code.alias("code"), message.alias("message"))


RUFF = "array<struct<filename:string,code:string,message:string,location:struct<row:int,column:int>>>"


def parse_ruff(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw(id, ...) -> a row a finding: a JSON array, or lines `file:l:c: CODE text`. Codes of E are errors."""
    level = lambda c: F.when(F.startswith(c, F.lit("E")), "error").otherwise("warning")
    is_json = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    j = raw.filter(is_json).select("id", F.posexplode(F.from_json(column, RUFF)).alias("pos", "r"))
    j = j.select("id", "pos", F.col("r.filename").alias("file"), F.coalesce("r.location.row", F.lit(0)).alias("line"), F.coalesce("r.location.column", F.lit(0)).alias("col"), level(F.coalesce("r.code", F.lit(""))).alias("severity"), F.coalesce("r.code", F.lit("")).alias("code"), F.col("r.message").alias("message"))
    p = r"^(.+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$"
    t = _lines(raw.filter(~is_json), column).filter(F.regexp_like("line", F.lit(p)))
    part = lambda k: F.regexp_extract("line", p, k)
    return j.unionByName(_rows(t, part(1), part(2), part(3), level(part(4)), part(4), part(5)))


def parse_tsc(raw: DataFrame, column: str = "raw") -> DataFrame:
    """`file(l,c): error TSn: text`."""
    p = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$"
    part = lambda k: F.regexp_extract("line", p, k)
    return _rows(_lines(raw, column).filter(F.regexp_like("line", F.lit(p))), part(1), part(2), part(3), part(4), part(5), part(6))


def parse_maven(raw: DataFrame, column: str = "raw") -> DataFrame:
    """`[ERROR] file.java:[l,c] text`; other error lines have line 0, and those that only frame the output are left out."""
    p = r"^\[ERROR\]\s+(.+?\.java):\[(\d+),(\d+)\]\s*(.*)$"
    t = _lines(raw, column).filter(F.startswith("line", F.lit("[ERROR]")))
    text = F.trim(F.regexp_replace("line", r"^\[ERROR\]\s*", ""))
    placed = F.regexp_like("line", F.lit(p))
    t = t.filter(placed | ((text != "") & ~F.contains(text, F.lit("BUILD FAILURE")) & ~F.startswith(text, F.lit("---"))))
    part = lambda k: F.regexp_extract("line", p, k)
    return _rows(t, part(1), part(2), part(3), F.lit("error"), F.lit(""), F.when(placed, part(4)).otherwise(text))


def parse_go(raw: DataFrame, column: str = "raw") -> DataFrame:
    """`file.go:l:c: text`."""
    p = r"^(.+?\.go):(\d+):(?:(\d+):)?\s*(.*)$"
    part = lambda k: F.regexp_extract("line", p, k)
    return _rows(_lines(raw, column).filter(F.regexp_like("line", F.lit(p))), part(1), part(2), part(3), F.lit("error"), F.lit(""), part(4))


CARGO = "reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,column_start:int,is_primary:boolean>>>"


def parse_cargo(raw: DataFrame, column: str = "raw") -> DataFrame:
    """JSON lines: compiler messages at their primary span."""
    t = _lines(raw, column).select("id", "pos", F.from_json("line", CARGO).alias("m")).filter("m.reason = 'compiler-message'")
    spot = F.get(F.filter("m.message.spans", lambda s: s["is_primary"]), F.lit(0))
    t = t.select("id", "pos", "m.message", spot.alias("s"))
    return t.select("id", "pos", F.coalesce("s.file_name", F.lit("")).alias("file"), F.coalesce("s.line_start", F.lit(0)).alias("line"), F.coalesce("s.column_start", F.lit(0)).alias("col"), F.col("message.level").alias("severity"), F.coalesce("message.code.code", F.lit("")).alias("code"), F.col("message.message").alias("message"))


def parse_pytest(raw: DataFrame, column: str = "raw") -> DataFrame:
    """A row a run: counts (the last of each in the output), failed tests and lines of tracebacks."""
    text = F.coalesce(F.col(column), F.lit(""))
    last = lambda word: F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(\d+) {word}"), F.lit(1)), F.lit(-1)).cast("int"), F.lit(0))
    lines = F.split(text, "\r?\n")
    failed = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("FAILED "))), lambda x: F.substring(x, F.lit(8), F.length(x)))
    trace = F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^E\s|^\S+\.py:\d+: ")))
    return raw.select("id", last("passed").alias("passed"), last("failed").alias("failed"), last("error").alias("errors"), failed.alias("failures"), trace.alias("traceback"))


def count_outcomes(raw: DataFrame, column: str = "raw") -> DataFrame:
    """A row a run of any tool: how often words of success and failure come up."""
    n = lambda p: F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(p))
    return raw.select("id", n(r"(?i)\b(pass(ed)?|ok)\b").alias("passed"), n(r"(?i)\bfail(ed|ure)?\b").alias("failed"), n(r"(?i)\berrors?\b").alias("errors"))


def only_file(rows: DataFrame, path: str) -> DataFrame:
    """Findings on one file, and those that name none."""
    return rows.filter((F.col("file") == "") | F.contains("file", F.lit(path)))
