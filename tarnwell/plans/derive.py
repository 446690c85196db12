"""Index relations derived from the test tables, and the same in SQL for another engine.

The test tables hold prose: a document is a file, a line that begins with a word defines a symbol, a word before a
period is a call, links of pages are imports, and events are commits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.operators import history, resolve
from tarnwell.plans.index import SCHEMAS, CodeIndex
from tarnwell.plans.schema import PER_FILE
from tarnwell.sources.store import shared_dir

EXTENSIONS = {"en": "py", "fr": "java", "de": "js"}


def files(docs: DataFrame) -> DataFrame:
    ext = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in EXTENSIONS.items()], F.lit("go"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "lang", F.col("doc_id").cast("double").alias("mtime"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))


def lines(docs: DataFrame) -> DataFrame:
    out = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return out.select("file_id", (F.col("p") + 1).alias("line_no"), "text")


def symbols(files: DataFrame, lines: DataFrame) -> DataFrame:
    name = F.lower(F.regexp_extract("text", r"^([A-Za-z]{3,})", 1))
    kind = F.when(F.col("line_no") % 3 == 0, "function").when(F.col("line_no") % 3 == 1, "method").otherwise("interface")
    named = lines.select("file_id", "line_no", name.alias("name"), kind.alias("kind"), F.max("line_no").over(W.partitionBy("file_id")).alias("n"))
    named = named.filter("name <> ''")
    after = F.lead("line_no").over(W.partitionBy("file_id").orderBy("line_no"))
    inner = named.select("file_id", "name", "kind", F.col("line_no").alias("line_start"), F.coalesce(after - 1, F.col("n")).alias("line_end"))
    outer = lines.groupBy("file_id").agg(F.max("line_no").alias("line_end"))
    outer = outer.select("file_id", F.concat(F.lit("doc_"), F.col("file_id").cast("string")).alias("name"), F.lit("class").alias("kind"), F.lit(1).alias("line_start"), "line_end")
    place = F.row_number().over(W.partitionBy("file_id").orderBy("line_start", "kind", "name"))
    both = inner.unionByName(outer).withColumn("id", F.col("file_id") * PER_FILE + place)
    dotted = resolve.qualified_name(F.col("path"), F.col("lang"), F.col("name"))
    joined = both.join(files.select(F.col("id").alias("f_id"), "path", "lang"), F.col("file_id") == F.col("f_id"))
    return joined.select("id", "file_id", "name", "kind", "line_start", "line_end", dotted.alias("qualified_name"))


def calls(lines: DataFrame) -> DataFrame:
    found = lines.select("file_id", F.col("line_no").alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]{3,})\."), F.lit(1))).alias("pos", "callee_name"))
    return found.filter(resolve.is_call_name(F.col("callee_name")))


def imports(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Links of a page, and for every file the dotted path of the file twenty ids on."""
    links = pages.select(F.col("page_id").alias("file_id"), F.explode(F.regexp_extract_all("html", F.lit(r'<a href="/([A-Za-z]{3,})"'), F.lit(1))).alias("module"))
    links = links.select("file_id", F.lower("module").alias("module"), F.lit(0).alias("level"))
    ahead = files.select((F.col("id") - 20).alias("file_id"), resolve.dotted_path(F.col("path"), F.col("lang")).alias("module"), F.lit(1).alias("level"))
    both = links.unionByName(ahead).groupBy("file_id", "module").agg(F.max("level").alias("level"))
    both = both.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    place = F.row_number().over(W.partitionBy("file_id").orderBy("module"))
    return both.select((F.col("file_id") * PER_FILE + place).alias("id"), "file_id", "module", "level", (F.length("module") % 7 == 0).alias("is_star"))


def hunks(events: DataFrame, files: DataFrame) -> DataFrame:
    """Each event is a commit with one hunk on the file of its user's number."""
    start = F.get_json_object("props", "$.k").cast("int")
    out = events.select(
        F.md5(F.col("event_id").cast("string")).alias("commit_hash"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("commit_date"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("commit_msg"),
        F.col("user_id").alias("file_id"), (start % 12 + 1).alias("start"), (F.col("event_id") % 10 + 1).cast("int").alias("count"),
    )
    return out.join(files.select(F.col("id").alias("f_id"), "path"), F.col("file_id") == F.col("f_id")).drop("f_id")


class Derived(CodeIndex):
    """The index of the tables in a folder. A relation is made when it is first asked for; those that take joins are written
    to the shared folder then, once for all queries of an application, as long as the tables' files are the same."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._states = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        """A relation that is not there yet."""
        if name not in SCHEMAS:
            raise AttributeError(name)
        make, sources = RELATIONS.get(name, (None, ()))
        if make is None:
            out = self._spark.createDataFrame([], SCHEMAS[name])
        else:
            out = self._at_rest(name, make, sources) if sources else make(self)
        setattr(self, name, out)
        return out

    def read(self, table: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{table}.parquet")

    def docs(self) -> DataFrame:
        return self.read("documents").select("doc_id", "text", "lang", "source")

    def _at(self, path: str):
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _state(self, table: str) -> str:
        """Names, sizes and times of a table's files."""
        if table not in self._states:
            at, fs = self._at(f"{self._dir}/{table}.parquet")
            found = [fs.getFileStatus(at), *fs.listStatus(at)]
            self._states[table] = " ".join(sorted(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in found))
        return self._states[table]

    def _at_rest(self, name: str, make: Callable[[Derived], DataFrame], sources: tuple[str, ...]) -> DataFrame:
        spark = self._spark
        key = hashlib.md5("\n".join([spark.sparkContext.applicationId, *map(self._state, sources)]).encode()).hexdigest()
        folder = f"{shared_dir(spark)}/derived-{key}"
        (path, fs), (tmp, _) = self._at(f"{folder}/{name}"), self._at(f"{folder}/.{name}-{uuid.uuid4().hex}")
        if not fs.exists(path):
            df = make(self)
            df.write.parquet(str(tmp))
            if fs.exists(path) or not fs.rename(tmp, path):  # another query was first
                fs.delete(tmp, True)
        return spark.read.parquet(str(path))


def _tokens(i: Derived) -> DataFrame:
    out = i.lines.select("file_id", F.col("line_no").alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))).alias("pos", "name"))
    return out.select("file_id", "line", "pos", F.lower("name").alias("name"))


def _vectors(i: Derived) -> DataFrame:
    return i.read("embeddings").select((F.col("vec_id") * PER_FILE + 1).alias("symbol_id"), "embedding", F.concat(F.lit("label"), F.col("label").cast("string")).alias("model"))


def _docstrings(i: Derived) -> DataFrame:
    first = i.lines.select(F.col("file_id").alias("l_file"), "line_no", "text")
    own = i.symbols.filter("kind = 'function'").join(first, (F.col("file_id") == F.col("l_file")) & (F.col("line_start") == F.col("line_no")))
    return own.select(F.col("id").alias("symbol_id"), F.col("text").alias("content"), "line_start", "line_end")


def _hints(i: Derived) -> DataFrame:
    return i.symbols.filter("kind = 'method'").select(F.col("id").alias("symbol_id"), F.concat(F.lit("p"), F.col("line_start").cast("string")).alias("param_name"), F.col("name").alias("annotation"), (F.col("line_start") % 2 == 0).alias("is_return"))


#: How a relation is made, and for those that are kept at rest the tables that it is made from.
RELATIONS: dict[str, tuple[Callable[[Derived], DataFrame], tuple[str, ...]]] = {
    "files": (lambda i: files(i.docs()), ()),
    "lines": (lambda i: lines(i.docs()), ()),
    "symbols": (lambda i: symbols(i.files, i.lines), ("documents",)),
    "calls": (lambda i: calls(i.lines), ()),
    "imports": (lambda i: imports(i.read("pages"), i.files), ("documents", "pages")),
    "call_edges": (lambda i: resolve.resolve_callees(resolve.enclosing_symbol(i.calls, i.symbols), i.symbols, i.imports, i.files), ("documents", "pages")),
    "embeddings": (_vectors, ()),
    "name_uses": (lambda i: _tokens(i).select("file_id", "name"), ()),
    "symbol_references": (lambda i: resolve.references_last(_tokens(i).filter("pos > 0"), i.symbols), ("documents",)),
    "git_history": (lambda i: history.index_hunks(hunks(i.read("events"), i.files), i.symbols), ()),
    "docstrings": (_docstrings, ()),
    "type_hints": (_hints, ()),
}


def derive(spark: SparkSession, sf_dir: str) -> CodeIndex:
    return Derived(spark, sf_dir)


#: The derivation in SQL, by relation: each may use those before it.
SQL_PARTS = {
    "files": """SELECT doc_id AS id, coalesce(source, '') || '/' || coalesce(lang, '') || '/doc_' || doc_id::VARCHAR || '.' ||
      CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'js' ELSE 'go' END AS path, lang, doc_id::DOUBLE AS mtime, md5(coalesce(text, '')) AS hash FROM documents""",
    "lines": """SELECT file_id, i::INT AS line_no, l[i] AS text FROM (SELECT doc_id AS file_id, string_split(text, chr(10)) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "named": """SELECT file_id, line_no, lower(regexp_extract(text, '^([A-Za-z]{3,})', 1)) AS name, CASE line_no % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'interface' END AS kind,
      max(line_no) OVER (PARTITION BY file_id) AS n FROM lines""",
    "raw_symbols": """SELECT file_id, name, kind, line_no AS line_start, coalesce(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no) - 1, n) AS line_end FROM (SELECT * FROM named WHERE name <> '')
      UNION ALL SELECT file_id, 'doc_' || file_id::VARCHAR, 'class', 1, max(line_no) FROM lines GROUP BY file_id""",
    "symbols": """SELECT file_id * 10000000 + row_number() OVER (PARTITION BY file_id ORDER BY line_start, kind, name) AS id, file_id, name, kind, line_start, line_end,
      replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') || '.' || name AS qualified_name FROM raw_symbols r JOIN files f ON r.file_id = f.id""",
    "calls": """SELECT file_id, line, (i - 1)::INT AS pos, c[i] AS callee_name FROM (SELECT file_id, line_no AS line, regexp_extract_all(text, '([A-Za-z]{3,})\\.', 1) AS c, generate_subscripts(regexp_extract_all(text, '([A-Za-z]{3,})\\.', 1), 1) AS i FROM lines)
      WHERE NOT regexp_matches(c[i], '^[A-Z]')""",
    "imports": """SELECT file_id * 10000000 + row_number() OVER (PARTITION BY file_id ORDER BY module) AS id, file_id, module, max(level) AS level, length(module) % 7 = 0 AS is_star FROM (
      SELECT page_id AS file_id, lower(unnest(regexp_extract_all(html, '<a href="/([A-Za-z]{3,})"', 1))) AS module, 0 AS level FROM pages
      UNION ALL SELECT id - 20, replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.'), 1 FROM files) x WHERE file_id IN (SELECT id FROM files) GROUP BY file_id, module""",
    "enclosed": """SELECT c.*, s.id AS caller_id FROM (SELECT c.file_id, c.line, c.pos, c.callee_name, s.id, row_number() OVER (PARTITION BY c.file_id, c.line, c.pos ORDER BY s.line_end - s.line_start, s.id) AS rn
      FROM calls c JOIN symbols s ON c.file_id = s.file_id AND c.line BETWEEN s.line_start AND s.line_end) c JOIN symbols s ON s.id = c.id WHERE rn = 1""",
    "tier1": """SELECT file_id, line, pos, id FROM (SELECT e.file_id, e.line, e.pos, s.id, row_number() OVER (PARTITION BY e.file_id, e.line, e.pos ORDER BY abs(s.line_start - c.line_start), s.id) AS rn
      FROM enclosed e JOIN symbols c ON c.id = e.caller_id JOIN symbols s ON s.file_id = e.file_id AND s.name = e.callee_name) WHERE rn = 1""",
    "tier2": """SELECT file_id, line, pos, id FROM (SELECT e.file_id, e.line, e.pos, s.id, row_number() OVER (PARTITION BY e.file_id, e.line, e.pos ORDER BY length(s.qualified_name), s.id) AS rn
      FROM enclosed e JOIN imports i ON i.file_id = e.file_id JOIN symbols s ON s.qualified_name = i.module || '.' || e.callee_name) WHERE rn = 1""",
    "tier3": "SELECT name, min(id) AS id FROM symbols GROUP BY name HAVING count(*) = 1",
    "call_edges": """SELECT e.caller_id, e.callee_name, e.line, e.pos, s.id AS callee_id, coalesce(s.qualified_name, s.name) AS resolved_name, f.path AS callee_file
      FROM enclosed e LEFT JOIN tier1 a USING (file_id, line, pos) LEFT JOIN tier2 b USING (file_id, line, pos) LEFT JOIN tier3 c ON c.name = e.callee_name
      LEFT JOIN symbols s ON s.id = coalesce(a.id, b.id, c.id) LEFT JOIN files f ON f.id = s.file_id""",
    "tokens": """SELECT file_id, line, (i - 1)::INT AS pos, lower(t[i]) AS name FROM (SELECT file_id, line_no AS line, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}') AS t,
      generate_subscripts(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), 1) AS i FROM lines)""",
    "symbol_references": "SELECT m.id AS symbol_id, t.file_id, t.line FROM tokens t JOIN (SELECT name, max(id) AS id FROM symbols GROUP BY name) m ON m.name = t.name WHERE t.pos > 0",
    "docstrings": "SELECT s.id AS symbol_id, l.text AS content, s.line_start, s.line_end FROM symbols s JOIN lines l ON l.file_id = s.file_id AND l.line_no = s.line_start WHERE s.kind = 'function'",
    "type_hints": "SELECT id AS symbol_id, 'p' || line_start::VARCHAR AS param_name, name AS annotation, line_start % 2 = 0 AS is_return FROM symbols WHERE kind = 'method'",
    "vectors": "SELECT vec_id * 10000000 + 1 AS symbol_id, embedding, 'label' || label::VARCHAR AS model FROM embeddings",
    "hunks": """SELECT md5(event_id::VARCHAR) AS commit_hash, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS commit_date, event_type || ' ' || event_id::VARCHAR AS commit_msg, user_id AS file_id, f.path,
      (json_extract_string(props, '$.k')::INT % 12 + 1) AS start, (event_id % 10 + 1)::INT AS count FROM events JOIN files f ON f.id = user_id""",
    "git_history": """SELECT s.id AS symbol_id, h.path AS file_path, h.commit_hash, min(h.commit_date) AS commit_date, min(h.commit_msg) AS commit_msg, 'logic_edit' AS change_type,
      sum(least(h.start + h.count - 1, s.line_end) - greatest(h.start, s.line_start) + 1)::INT AS lines_added, 0 AS lines_removed
      FROM hunks h JOIN symbols s ON s.file_id = h.file_id AND h.start <= s.line_end AND s.line_start <= h.start + h.count - 1 GROUP BY s.id, h.path, h.commit_hash""",
    "edge_view": """SELECT c.name AS caller_name, cf.path AS caller_file, c.line_start AS caller_line, e.callee_name, e.callee_file, e.callee_id, e.caller_id, e.line, e.pos
      FROM call_edges e JOIN symbols c ON c.id = e.caller_id JOIN files cf ON cf.id = c.file_id""",
}


def sql(query: str, recursive: bool = False) -> str:
    """A query over derived relations with the definitions that it needs."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL_PARTS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(SQL_PARTS[name])

    visit(query)
    parts = ", ".join(f"{n} AS MATERIALIZED ({SQL_PARTS[n]})" for n in SQL_PARTS if n in need)
    if not parts:
        return query
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{parts}{', ' + query[5:] if query.startswith('WITH ') else ' ' + query}"
