"""Change history: log parsing, hunks against symbols, a symbol's commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "commit_date"


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """`hash|date|subject` lines; the subject may hold bars."""
    part = F.split(F.col(column), r"\|", 3)
    return lines.filter(F.size(part) == 3).select(part[0].alias("commit_hash"), part[1].alias(DATE), part[2].alias("commit_msg"))


def hunk_range(header: Column) -> Column:
    """(start, count) of the new side of a hunk header; a missing count is 1."""
    return F.struct(F.regexp_extract(header, r"\+(\d+)(?:,(\d+))?", 1).cast("int").alias("start"), F.coalesce(F.nullif(F.regexp_extract(header, r"\+(\d+)(?:,(\d+))?", 2), F.lit("")).cast("int"), F.lit(1)).alias("count"))


def classify_change(old: Column, new: Column) -> Column:
    """new / deleted / signature_change / logic_edit by the first lines of both sides (arrays of lines)."""
    return F.when(F.size(old) <= 0, "new").when(F.size(new) <= 0, "deleted").when(F.trim(F.get(old, F.lit(0))) != F.trim(F.get(new, F.lit(0))), "signature_change").otherwise("logic_edit")


#: Lines of a bin of a file; ranges meet in bins that both touch.
BIN = 128


def _binned(rows: DataFrame, first: str, last: str) -> DataFrame:
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(first) / BIN), F.floor(F.greatest(first, last) / BIN))))


def index_hunks(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """hunks(commit_hash, commit_date, commit_msg, file_id, path, start, count) -> git_history rows: the lines that all
    hunks of a commit add to each symbol that they overlap. Ranges meet by file and bin of lines, so a file of many symbols
    and hunks is many small groups; a pair that shares several bins counts in the first of them."""
    h = _binned(hunks.withColumn("stop", F.col("start") + F.col("count") - 1), "start", "stop")
    s = _binned(symbols.select(F.col("id").alias("symbol_id"), F.col("file_id").alias("s_file"), "line_start", "line_end"), "line_start", "line_end").withColumnRenamed("bin", "s_bin")
    overlap = (F.col("start") <= F.col("line_end")) & (F.col("line_start") <= F.col("stop"))
    met = h.join(s, (F.col("file_id") == F.col("s_file")) & (F.col("bin") == F.col("s_bin")) & overlap & (F.floor(F.greatest("start", "line_start") / BIN) == F.col("bin")))
    size = F.least("stop", "line_end") - F.greatest("start", "line_start") + 1
    out = met.groupBy("symbol_id", F.col("path").alias("file_path"), "commit_hash").agg(F.min(DATE).alias(DATE), F.min("commit_msg").alias("commit_msg"), F.sum(size).cast("int").alias("lines_added"))
    return out.select(F.xxhash64("symbol_id", "commit_hash").alias("id"), "symbol_id", "file_path", "commit_hash", DATE, "commit_msg", F.lit("logic_edit").alias("change_type"), "lines_added", F.lit(0).alias("lines_removed"))


COMMIT = "commit "


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """An exported log with diffs (`commit hash|date|subject` lines, each with its diffs of files below) as one row a commit:
    value. The reader cuts the text at commits, so large logs are split among tasks."""
    return spark.read.option("lineSep", "\n" + COMMIT).text(path)


def diff_files(commits: DataFrame) -> DataFrame:
    """commits(value) -> commit_hash, commit_date, commit_msg, path, old_path, kind, body: one row a file of a commit; kind is
    binary, mode, renamed, deleted, new or changed. A commit without files has no row, nor has one whose line is malformed."""
    value = F.regexp_replace("value", "^" + COMMIT, "")
    parts = commits.select(F.split(F.split(value, "\r?\n", 2)[0], r"\|", 3).alias("head"), F.explode(F.slice(F.split(F.concat(F.lit("\n"), value), "\ndiff --git "), F.lit(2), F.lit(1 << 30))).alias("file")).filter(F.size("head") == 3)
    head = F.split("file", "\n@@ ", 2)[0]  # lines of a hunk can look like a header's
    line = lambda start: F.nullif(F.regexp_extract(head, f"(?m)^{start}(.*?)\r?$", 1), F.lit(""))
    has = lambda p: F.regexp_like(head, F.lit(f"(?m)^{p}"))
    # the first line names both sides as a/x b/x; only it is there if nothing but the mode has changed
    same = F.regexp_extract(head, r"^a/(.*) b/\1\r?(?:\n|$)", 1)
    new, old = line(r"\+\+\+ b/"), line(r"--- a/")
    kind = F.when(has("(Binary files .* differ|GIT binary patch)"), "binary").when(has("rename to "), "renamed").when(has("deleted file mode "), "deleted").when(has("new file mode "), "new")
    kind = kind.when(~F.contains("file", F.lit("\n@@ ")), "mode").otherwise("changed")
    path = F.coalesce(line("rename to "), new, old, F.nullif(same, F.lit("")))
    return parts.select(
        F.col("head")[0].alias("commit_hash"), F.col("head")[1].alias(DATE), F.col("head")[2].alias("commit_msg"), path.alias("path"), F.coalesce(line("rename from "), old, F.when(kind != "new", path)).alias("old_path"), kind.alias("kind"), F.col("file").alias("body"),
    )


def diff_hunks(commits: DataFrame) -> DataFrame:
    """commits(value) -> commit_hash, commit_date, commit_msg, path, start, count: the lines that each hunk leaves in its
    file; deleted files and hunks that only take lines away (a count of 0) have none."""
    files = diff_files(commits).filter("kind not in ('deleted', 'binary')")
    hunk = files.select("commit_hash", DATE, "commit_msg", "path", F.explode(F.slice(F.split("body", "\n@@ "), F.lit(2), F.lit(1 << 30))).alias("hunk"))
    found = hunk.select("commit_hash", DATE, "commit_msg", "path", hunk_range(F.substring_index("hunk", " @@", 1)).alias("r"))
    return found.select("commit_hash", DATE, "commit_msg", "path", "r.start", "r.count").filter("count > 0")


def function_history(history: DataFrame, symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """The latest commits on symbols of a name: dates compare as times, their text breaks ties."""
    of = symbols.filter(F.col("name") == name).select(F.col("id").alias("symbol_id"), "name")
    rows = history.join(of, "symbol_id")
    return rows.orderBy(F.desc(F.try_to_timestamp(DATE)), F.desc(DATE), "commit_hash", "symbol_id").limit(limit).select("name", "symbol_id", F.substring("commit_hash", 1, 8).alias("commit"), DATE, "commit_msg", "change_type", "lines_added", "lines_removed", "file_path")


def first_per_commit(rows: DataFrame) -> DataFrame:
    """Insert-or-ignore: of rows with one (symbol_id, commit_hash) the first by id stays."""
    first = F.min_by(F.struct(*[c for c in rows.columns]), "id").alias("r")
    return rows.groupBy("symbol_id", "commit_hash").agg(first).select("r.*")
