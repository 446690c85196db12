"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import materialize, row_key, table

#: A line on more than this part of a host's pages, and on MIN_PAGES of them at least, is boilerplate.
RATIO, MIN_PAGES = 0.1, 5
#: Boilerplate lines of all hosts that are broadcast at most (about 40 bytes each).
BROADCAST_ROWS = 100_000
BLANK = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _mark(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.concat_ws(":", F.xxhash64(line).cast("string"), F.hash(line).cast("string"))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, mark: the lines (trimmed, not blank) on over `ratio` of a host's pages.

    A page counts once for a line. Counting is summed before the shuffle, and its keys are (host, line), so a hot host
    is spread over all tasks. A null host is a host.
    """
    bare = F.array_distinct(F.filter(F.transform(F.split(F.col(text_col), "\n"), _bare), lambda x: x != ""))
    lines = docs.select(F.col(host_col).alias("host"), F.explode(bare).alias("line"))
    counts = lines.groupBy("host", F.xxhash64("line").alias("a"), F.hash("line").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    pages = docs.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("pages"))
    c, p = counts.alias("c"), pages.alias("p")
    over = c.join(p, F.col("c.host").eqNullSafe(F.col("p.host"))).filter(F.col("c.n") > F.lit(ratio) * F.col("p.pages"))
    return over.select("c.host", F.concat_ws(":", F.col("c.a").cast("string"), F.col("c.b").cast("string")).alias("mark"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """row (a struct of all columns of docs), text, n_lines, n_dropped: texts without their host's boilerplate lines.

    A host has at most (mean lines of its pages) / ratio boilerplate lines, so its list is short. The lists of all
    hosts are counted first: up to `broadcast_rows` they are broadcast to the documents; beyond, documents' lines meet
    them in a join on (host, line), and what was found goes back to its document by key.

    Null texts stay null and have no lines; blank lines are kept; texts that lose all lines become empty, and the row
    stays. Repeated rows are pages of their own.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"), docs[host_col].alias("host"))
    bad = materialize(boilerplate(docs, text_col, host_col, ratio, min_pages))
    if bad.count() <= broadcast_rows:
        lists = bad.groupBy("host").agg(F.collect_set("mark").alias("bad")).alias("b")
        joined = packed.alias("d").join(F.broadcast(lists), F.col("d.host").eqNullSafe(F.col("b.host")), "left").select("d.row", "d.text", "b.bad")
    else:
        keyed = packed.withColumn("key", row_key(F.col(f"row.`{id_col}`"), F.concat_ws("\x01", "host", "text")))
        lines = keyed.select("key", "host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _bare))).alias("line")).select("key", "host", _mark(F.col("line")).alias("mark"))
        l, b = lines.alias("l"), bad.alias("b")
        hit = l.join(b, (F.col("l.mark") == F.col("b.mark")) & F.col("l.host").eqNullSafe(F.col("b.host"))).groupBy("l.key").agg(F.collect_set("l.mark").alias("bad"))
        joined = keyed.join(hit, "key", "left").select("row", "text", "bad")
    lines = F.split("text", "\n")
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), _mark(_bare(x)))))
    out = joined.select("row", "text", lines.alias("lines"), kept.alias("kept"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return out.select(
        "row",
        F.when(size("kept") == size("lines"), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        size("lines").cast("long").alias("n_lines"),
        (size("lines") - size("kept")).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "row.source", "n_lines", "n_dropped", "text")


SQL = r"""
WITH l AS (
  SELECT DISTINCT doc_id, source, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents)),
bad AS (
  SELECT c.source, line FROM (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL) c
  JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) p ON c.source IS NOT DISTINCT FROM p.source
  WHERE n >= 5 AND n > 0.1::DOUBLE * pages),
b AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
k AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)),
                     lambda x: NOT list_contains(coalesce(b.bad, []), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
  FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM k
"""
