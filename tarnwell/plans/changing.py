"""Queries on what changes: state of streams, a tree on disk, logs of diffs, the call graph after edits, work that goes on."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import embed
from tarnwell.operators import graph, history
from tarnwell.plans.derive import derive, hunks
from tarnwell.plans.queries import ROOT, WHOLE_WALK, query
from tarnwell.plans.rendered import PARTS, PATHS, SYMBOLS, _changed, _index, parts
from tarnwell.plans.rendered import query as rendered
from tarnwell.sources import tree
from tarnwell.sources.store import shared_dir
from tarnwell.streaming import state


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# --- streams with state -------------------------------------------------------------------------------------------------------
@rendered("""WITH e AS (SELECT event_type AS log, event_id AS i, user_id::VARCHAR AS text, (SELECT max(event_id) // 2 FROM events) AS cut FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY log, i > cut ORDER BY i DESC) AS r FROM e)
SELECT 'late' AS reader, log, i AS "at", text, i > cut AS live FROM t WHERE i > cut OR r <= 500""")
def log_follow(spark, sf_dir):
    """All events as lines of a log each, and a reader that joins halfway: the last 500 lines before, and all that follow."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.select(F.col("event_type").alias("log"), F.col("event_id").alias("at"), F.lit(None).cast("string").alias("reader"), F.col("user_id").cast("string").alias("text"))
    cut = e.agg(F.expr("max(event_id) div 2").alias("at"))
    joins = e.select(F.col("event_type").alias("log")).distinct().join(F.broadcast(cut), F.lit(True)).select("log", "at", F.lit("late").alias("reader"), F.lit(None).cast("string").alias("text"))
    at = _folder(spark, "follow")
    lines.unionByName(joins).write.parquet(f"{at}/in")
    state.run_follow(spark.readStream.schema(state.EVENT).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(state.SENT).parquet(f"{at}/out")


# --- a tree on disk -----------------------------------------------------------------------------------------------------------
@rendered(f"""WITH {PARTS}, t AS (SELECT CASE WHEN s <= 5 THEN 'node_modules' WHEN s <= 10 THEN 'build-x' WHEN s <= 25 THEN 'src' ELSE 'lib' END AS top, s, 17 + f AS n FROM p)
SELECT 'top=' || top || '/size=' || s AS folder, sum(n)::BIGINT AS n_lines FROM t WHERE top IN ('src', 'lib') GROUP BY ALL""")
def tree_scan(spark, sf_dir):
    """Parts laid out as text files in folders by size, of which some are skipped by name or by name and `-`."""
    top = F.when(F.col("s") <= 5, "node_modules").when(F.col("s") <= 10, "build-x").when(F.col("s") <= 25, "src").otherwise("lib")
    rows = parts(spark, sf_dir).select(top.alias("top"), F.col("s").alias("size"), F.regexp_replace("content", "\n$", "").alias("value"))
    at = _folder(spark, "tree")
    rows.repartition("top", "size").write.partitionBy("top", "size").text(at)
    found = tree.listing(spark, at, skip=("top=node_modules", "top=build"), suffixes=("txt",), joined=True)
    return tree.with_content(found, at).groupBy("folder").agg(F.sum(F.size(F.split("content", "\n")) - 1).cast("long").alias("n_lines"))


# --- logs of diffs ------------------------------------------------------------------------------------------------------------
def _log(spark, commits: DataFrame) -> DataFrame:
    """commits(commit_hash, commit_date, commit_msg, path, start, count) as an exported log, read again."""
    s, p = (lambda c: F.col(c).cast("string")), F.col("path")
    text = F.concat(
        F.lit(history.COMMIT), F.concat_ws("|", "commit_hash", "commit_date", "commit_msg"), F.lit("\n\ndiff --git a/"), p, F.lit(" b/"), p, F.lit("\nindex 1a..2b 100644\n--- a/"), p, F.lit("\n+++ b/"), p,
        F.lit("\n@@ -1,0 +"), s("start"), F.lit(","), s("count"), F.lit(" @@ def x():"), F.repeat(F.lit("\n+++ b/not a header"), F.col("count")), F.lit("\n@@ -9 +8,0 @@\n-gone"),
        F.lit("\ndiff --git a/run.sh b/run.sh\nold mode 100644\nnew mode 100755\ndiff --git a/old "), s("start"), F.lit(".py b/new.py\nsimilarity index 100%\nrename from old "), s("start"), F.lit(".py\nrename to new.py"),
        F.lit("\ndiff --git a/logo.png b/logo.png\nindex 3c..4d 100644\nBinary files a/logo.png and b/logo.png differ\ndiff --git a/z.py b/z.py\ndeleted file mode 100644\n--- a/z.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y"),
    )
    at = _folder(spark, "log")
    commits.select(text.alias("value")).write.text(at)
    return history.read_diffs(spark, at)


@query("SELECT symbol_id, file_path, commit_hash, commit_date, commit_msg, change_type, lines_added, lines_removed FROM git_history")
def diff_overlap(spark, sf_dir):
    """hunk_overlap, with the hunks read from a log of diffs."""
    i = derive(spark, sf_dir)
    log = _log(spark, hunks(spark.read.parquet(f"{sf_dir}/events.parquet"), i.files))
    found = history.diff_hunks(log).join(i.files.select(F.col("id").alias("file_id"), "path"), "path")
    return history.index_hunks(found, i.symbols).select("symbol_id", "file_path", "commit_hash", "commit_date", "commit_msg", "change_type", "lines_added", "lines_removed")


@query("""WITH k AS (SELECT *, unnest([{'path': path, 'old': path, 'kind': 'changed'}, {'path': 'run.sh', 'old': 'run.sh', 'kind': 'mode'}, {'path': 'new.py', 'old': 'old ' || start || '.py', 'kind': 'renamed'},
  {'path': 'logo.png', 'old': 'logo.png', 'kind': 'binary'}, {'path': 'z.py', 'old': 'z.py', 'kind': 'deleted'}]) AS x FROM hunks)
SELECT commit_hash, x.path AS path, x.old AS old_path, x.kind AS kind FROM k""")
def diff_kinds(spark, sf_dir):
    i = derive(spark, sf_dir)
    return history.diff_files(_log(spark, hunks(spark.read.parquet(f"{sf_dir}/events.parquet"), i.files))).select("commit_hash", "path", "old_path", "kind")


# --- the call graph -----------------------------------------------------------------------------------------------------------
GONE = "src7/%"
LIVE_AFTER = WHOLE_WALK.replace(
    "AND caller_id IN (SELECT id FROM symbols))", f"AND caller_id IN (SELECT id FROM symbols) AND NOT EXISTS (SELECT 1 FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id IN (callee_id, caller_id) AND f.path LIKE '{GONE}'))"
)


@query(f"WITH {LIVE_AFTER} SELECT symbol_id, caller_id, depth FROM walk", recursive=True)
def closure_after_delete(i):
    """The closure of all calls, and then what is left of it once a source's files have gone."""
    edges = graph.written(graph.live_edges(i))
    gone = graph.written(i.symbols.join(i.files.filter(F.col("path").like(GONE)).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id"))
    left = edges.join(gone.withColumnRenamed("id", "callee_id"), "callee_id", "left_anti").join(gone.withColumnRenamed("id", "caller_id"), "caller_id", "left_anti")
    whole, left = graph.written(graph.closure(edges)), graph.written(left.select("callee_id", "caller_id"))
    new, dead = graph.changed_closure(whole, left, edges.join(left, ["callee_id", "caller_id"], "left_anti"), edges.limit(0))
    return whole.join(dead, ["symbol_id", "caller_id"], "left_anti").unionByName(new)


@query(f"""WITH {WHOLE_WALK}, circles AS (SELECT a.symbol_id AS id, a.caller_id AS other FROM walk a JOIN walk b ON b.symbol_id = a.caller_id AND b.caller_id = a.symbol_id WHERE a.symbol_id <> a.caller_id)
SELECT id, least(id, min(other)) AS component FROM circles GROUP BY id""", recursive=True)
def call_cycles(i):
    """Symbols that call each other in a circle, by the least id of it."""
    found = graph.strong_components(graph.written(graph.live_edges(i)))
    many = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return found.join(many, "component").select("id", "component")


@query(f"WITH {WHOLE_WALK} SELECT depth, count(*) AS n_callers FROM walk WHERE symbol_id = (SELECT min(id) FROM symbols WHERE name = '{ROOT}') GROUP BY depth", recursive=True)
def blast_radius_reach(i):
    return graph.blast_radius_of(i, ROOT)


# --- work that goes on --------------------------------------------------------------------------------------------------------
@rendered(f"""WITH {PARTS} SELECT 1 AS version, count(*) AS files, 0::BIGINT AS ended, 4 * count(*) AS symbols FROM p
  UNION ALL SELECT 2, count(*) FILTER (s <= 10), count(*) FILTER (s <= 10 OR s > 45), 4 * count(*) FILTER (s <= 10) FROM p""")
def store_commits(spark, sf_dir):
    """What each batch of a store has added and ended, as its commits say."""
    store = _changed(spark, sf_dir)
    marks = spark.read.json(f"{store.at.path}/commits")
    version: Column = F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("int")
    return marks.select(version.alias("version"), F.col("files.added").alias("files"), F.col("files.buried").alias("ended"), F.col("symbols.added").alias("symbols"))


@rendered(" UNION ALL ".join(f"SELECT {PATHS} AS path, {n} AS name FROM p" for n, *_ in SYMBOLS).join([f"WITH {PARTS} ", ""]))
def embedding_resumed(spark, sf_dir):
    """Symbols with a vector after a run that was stopped and one that went on."""
    i = _index(spark, sf_dir)
    job = embed.EmbeddingJob(spark, _folder(spark, "vectors"), slices=4)
    job.run(i, after=lambda status: job.stop() if status["done"] else None)
    job.run(i)
    named = i.symbols.join(i.files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("symbol_id"), "path", "name")
    return job.vectors().filter("embedding is not null").join(named, "symbol_id").select("path", "name")
