"""Queries on source files and tool output that are rendered from the test tables, so that SQL can state what is in them.

Each part is a Python file, each supplier a file of another language, each event a line of tool output: parsers, editors and
the index are run on the rendered text, and the SQL says from the tables what they must find.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import blocks, embed, extract, logs, textops
from tarnwell.operators import audit, context, graph, history, symbols, textsearch
from tarnwell.plans.queries import ORACLE, QUERIES
from tarnwell.sources import ingest, scan
from tarnwell.sources.store import shared_dir, written
from tarnwell.streaming import changes


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return wrap


# --- a Python file for each part ----------------------------------------------------------------------------------------------
#: Its lines; {k} is the part's key, {n} the next one's, {s} its size. FILL comes size % 4 times behind line 9.
LINES = (
    "import json", "from pkg.mod_{s} import helper_{s} as h_{s}", "import os.path as osp, sys", "", "class Part{k}:", '    """Part {k}."""', "", "    def price_{k}(self, scale: float) -> float:", '        """Price of {k}."""',
    "        return h_{s}(scale) + self.base()", "", 'def make_{k}(n: int, label="x"):', "    json.dumps(n)", "    return make_{n}(price_{k}(n))", "", "LIMIT_{k} = {s}", "square_{k} = lambda x: x * x",
)
FILL, AT = "        scale = scale + 1", 9


def _filled(line: str) -> Column:
    out = F.lit(line)
    for mark, value in (("{k}", F.col("k")), ("{n}", F.col("k") + 1), ("{s}", F.col("s"))):
        out = F.replace(out, F.lit(mark), value.cast("string")) if mark in line else out
    return out


def _lines(first: int, last: int, end: str = "\n") -> str:
    """SQL of lines first..last (1-based, of LINES) with FILL in between, joined by line breaks."""
    parts = []
    for i in range(first, last + 1):
        text = "'" + LINES[i - 1].replace("'", "''") + "'"
        for mark, value in (("{k}", "k"), ("{n}", "(k + 1)"), ("{s}", "s")):
            text = text.replace(mark, f"' || {value} || '")
        parts.append(text)
        if i == AT and last > AT:
            parts.append(f"repeat('{FILL}' || chr(10), f) || ")
    sql, glue = "", ""
    for p in parts:
        if p.endswith("|| "):
            sql += glue + p
            glue = ""
        else:
            sql += glue + p
            glue = " || chr(10) || "
    return sql


PARTS = "p AS (SELECT p_partkey AS k, p_size AS s, p_size % 4 AS f FROM part)"
PATHS = "'src/m' || k || '.py'"


#: Parts that one task renders and parses: a table of these short rows is read by one task or few, and each becomes a file.
EACH = 4_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, s, id, path, lang, content."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    rows = p.count()
    p = p.repartition(-(-rows // EACH), "k") if rows > EACH else p
    lines = F.concat(F.array(*map(_filled, LINES[:AT])), F.array_repeat(F.lit(FILL), (F.col("s") % 4).cast("int")), F.array(*map(_filled, LINES[AT:])))
    return p.select("k", "s", F.col("k").cast("long").alias("id"), F.concat(F.lit("src/m"), F.col("k"), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


def _facts(spark, sf_dir, fact: str) -> DataFrame:
    return extract.extract(parts(spark, sf_dir)).filter(F.col("fact") == fact)


def _union(*rows: str) -> str:
    return f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT {r} FROM p" for r in rows)


SYMBOLS = (("'Part' || k", "class", "5", "10 + f"), ("'price_' || k", "function", "8", "10 + f"), ("'make_' || k", "function", "12 + f", "14 + f"), ("'square_' || k", "function", "17 + f", "17 + f"))


@query(_union(*[f"k AS file_id, {n} AS name, '{kind}' AS kind, {a} AS line_start, {b} AS line_end" for n, kind, a, b in SYMBOLS]))
def parsed_symbols(spark, sf_dir):
    return _facts(spark, sf_dir, "symbol").select("file_id", "name", "kind", "line_start", "line_end")


@query(_union("k AS file_id, 'h_' || s AS name, 10 + f AS line, true AS bare", "k, 'base', 10 + f, false", "k, 'dumps', 13 + f, false", "k, 'make_' || (k + 1), 14 + f, true", "k, 'price_' || k, 14 + f, true"))
def parsed_calls(spark, sf_dir):
    return _facts(spark, sf_dir, "call").select("file_id", "name", F.col("line_start").alias("line"), F.col("flag").alias("bare"))


@query(_union("k AS file_id, 'json' AS module, 0 AS level, false AS is_star, 1 AS line", "k, 'pkg.mod_' || s, 0, false, 2", "k, 'os.path', 0, false, 3", "k, 'sys', 0, false, 3"))
def parsed_imports(spark, sf_dir):
    return _facts(spark, sf_dir, "import").select("file_id", F.col("name").alias("module"), "level", F.col("flag").alias("is_star"), F.col("line_start").alias("line"))


@query(_union("k AS file_id, 'json' AS name, 'json' AS module", "k, 'h_' || s, 'pkg.mod_' || s", "k, 'osp', 'os.path'", "k, 'sys', 'sys'"))
def imported_names(spark, sf_dir):
    return _facts(spark, sf_dir, "imported").select("file_id", "name", F.col("detail").alias("module"))


@query(_union("k AS file_id, 'Part' || k AS name, 'Part ' || k || '.' AS content, 5 AS line_start, 10 + f AS line_end", "k, 'price_' || k, 'Price of ' || k || '.', 8, 10 + f"))
def parsed_docstrings(spark, sf_dir):
    return _facts(spark, sf_dir, "docstring").select("file_id", "name", F.col("detail").alias("content"), "line_start", "line_end")


@query(_union("k AS file_id, 'price_' || k AS name, 'scale' AS param, 'float' AS annotation, false AS is_return", "k, 'price_' || k, '', 'float', true", "k, 'make_' || k, 'n', 'int', false"))
def parsed_hints(spark, sf_dir):
    part = F.split("detail", "\x01")
    return _facts(spark, sf_dir, "hint").select("file_id", "name", part[0].alias("param"), part[1].alias("annotation"), F.col("flag").alias("is_return"))


NAMES = (("'float'", "8", 2), ("'h_' || s", "10 + f", 1), ("'scale'", "10 + f", 1), ("'self'", "10 + f", 1), ("'base'", "10 + f", 1), ("'int'", "12 + f", 1), ("'json'", "13 + f", 1), ("'n'", "13 + f", 1), ("'dumps'", "13 + f", 1),
         ("'make_' || (k + 1)", "14 + f", 1), ("'price_' || k", "14 + f", 1), ("'n'", "14 + f", 1), ("'LIMIT_' || k", "16 + f", 1), ("'square_' || k", "17 + f", 1), ("'x'", "17 + f", 2))


@query(_union(*[f"k AS file_id, {n} AS name, ({a})::BIGINT AS line, {c}::BIGINT AS n" for n, a, c in NAMES], "k, 'scale', 9 + i, 2").replace("SELECT k, 'scale', 9 + i, 2 FROM p", "SELECT k, 'scale', 9 + i, 2 FROM p, (SELECT unnest(range(1, 4)) AS i) WHERE i <= f"))
def parsed_names(spark, sf_dir):
    return _facts(spark, sf_dir, "name").groupBy("file_id", "name", F.col("line_start").cast("long").alias("line")).agg(F.count("*").alias("n"))


def _broken(spark, sf_dir) -> DataFrame:
    """The files with a line of another Python before their last function, a third of them with an open bracket there."""
    line = F.when(F.col("s") < 17, F.lit("x = (1,\n")).otherwise(F.lit("print 'x'\n"))
    content = F.replace("content", F.concat(F.lit("def make_"), F.col("k")), F.concat(line, F.lit("def make_"), F.col("k")))
    return extract.extract(parts(spark, sf_dir).withColumn("content", content))


@query(_union("k AS file_id, 12 + f AS line"))
def parse_errors(spark, sf_dir):
    return _broken(spark, sf_dir).filter("fact = 'error'").select("file_id", F.col("line_start").alias("line"))


@query(_union(*[f"k AS file_id, {n} AS name, {a} AS line_start, {b} AS line_end" for n, _, a, b in SYMBOLS[:2]]))
def parsed_broken(spark, sf_dir):
    """Symbols that stand before the line that doesn't parse."""
    return _broken(spark, sf_dir).filter("fact = 'symbol'").select("file_id", "name", "line_start", "line_end")


@query(_union(*[f"k AS file_id, {_lines(i, i)} AS statement" for i in (1, 2, 3)]))
def import_statements(spark, sf_dir):
    @F.pandas_udf("array<string>")
    def run(content: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([extract.raw_imports(c, x) for c, x in zip(content, lang)])

    return parts(spark, sf_dir).select(F.col("id").alias("file_id"), F.explode(run("content", "lang")).alias("statement"))


BLOCKS = (("import", None, 1, 1), ("import", None, 2, 2), ("import", None, 3, 3), ("class", "'Part' || k", 5, 10), ("function", "'make_' || k", 12, 14), ("constant", "'LIMIT_' || k", 16, 16), ("other", None, 17, 17))
BLOCK = "array<struct<kind:string,name:string,source:string>>"


@query(_union(*[f"k AS id, '{kind}' AS kind, {name or 'NULL'} AS name, {_lines(a, b)} AS source" for kind, name, a, b in BLOCKS]))
def parse_blocks(spark, sf_dir):
    @F.pandas_udf(BLOCK)
    def run(content: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([[(b.kind, b.name, b.source) for b in blocks.parse_blocks(c, p)] for c, p in zip(content, path)])

    return parts(spark, sf_dir).select("id", F.explode(run("content", "path")).alias("b")).select("id", "b.*")


# --- the index of those files ---------------------------------------------------------------------------------------------------
def _index(spark, sf_dir, with_closure: bool = False):
    return ingest.build(spark, parts(spark, sf_dir).select("path", "content"), with_closure)


TOP = "t AS (SELECT max(p_partkey) AS top FROM part)"


@query(_union(*[f"{PATHS} AS path, {n} AS name, '{kind}' AS kind, {a} AS line_start, {b} AS line_end, 'src.m' || k || '.' || {n} AS qualified_name" for n, kind, a, b in SYMBOLS]))
def built_symbols(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.symbols.join(i.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "name", "kind", "line_start", "line_end", "qualified_name")


@query(f"""WITH {PARTS}, {TOP} SELECT 'price_' || k AS caller, 'h_' || s AS callee, 10 + f AS line, NULL AS resolved, NULL AS file FROM p UNION ALL SELECT 'price_' || k, 'base', 10 + f, NULL, NULL FROM p
  UNION ALL SELECT 'make_' || k, 'dumps', 13 + f, NULL, NULL FROM p UNION ALL SELECT 'make_' || k, 'price_' || k, 14 + f, 'src.m' || k || '.price_' || k, {PATHS} FROM p
  UNION ALL SELECT 'make_' || k, 'make_' || (k + 1), 14 + f, CASE WHEN k < top THEN 'src.m' || (k + 1) || '.make_' || (k + 1) END, CASE WHEN k < top THEN 'src/m' || (k + 1) || '.py' END FROM p, t""")
def built_edges(spark, sf_dir):
    i = _index(spark, sf_dir)
    named = i.call_edges.join(i.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
    return named.select("caller", F.col("callee_name").alias("callee"), "line", F.when(F.col("callee_id").isNotNull(), F.col("resolved_name")).alias("resolved"), F.col("callee_file").alias("file"))


@query(_union("'os.path' AS module, 0 AS level, " + PATHS + " AS path", "'sys', 0, " + PATHS))
def unused_imports(spark, sf_dir):
    return audit.unused_imports(_index(spark, sf_dir)).select("module", "level", "path")


@query("SELECT 'src/m' || max(p_partkey) || '.py' AS path, 'make_' || (max(p_partkey) + 1) AS name FROM part")
def unresolved_calls(spark, sf_dir):
    return audit.unresolved_calls(_index(spark, sf_dir))


@query("SELECT x AS scope, true AS blocked, round((3 * count(*) + 1) / (5 * count(*)) * 100)::INT || '% of calls are unresolved; the limit is 30%' AS reason FROM part, (SELECT unnest(['imports', 'symbols', 'calls']) AS x) GROUP BY x")
def unused_gate(spark, sf_dir):
    i = _index(spark, sf_dir)
    return spark.createDataFrame([(s, g["blocked"], g["reason"]) for s in ("imports", "symbols", "calls") for g in [audit.find_unused(i, s)[0]]], "scope string, blocked boolean, reason string")


@query(f"""WITH {PARTS} SELECT 'square_' || k AS name FROM p UNION ALL SELECT 'make_' || min(k) FROM p""")
def unused_definitions(spark, sf_dir):
    return audit.find_unused(_index(spark, sf_dir), "symbols", max_unresolved=0.9)[1].select("name")


@query(_union(*[f"{n} AS name, '{kind}' AS kind, {_lines(a, b)} AS source, CASE WHEN '{kind}' = 'class' THEN {_lines(5, 5)} ELSE {head} END AS signature" for n, kind, a, b, head in
                [("'Part' || k", "class", 5, 10, "''"), ("'price_' || k", "function", 8, 10, _lines(8, 8)), ("'make_' || k", "function", 12, 14, _lines(12, 12)), ("'square_' || k", "function", 17, 17, "''")]]))
def signatures(spark, sf_dir):
    i = _index(spark, sf_dir)
    return symbols.with_source(i.symbols, i.lines).select("name", "kind", "source", textops.signature(F.split("source", "\n")).alias("signature"))


@query(f"""WITH {PARTS} SELECT 'make_' || k AS name, {PATHS} AS path, {_lines(12, 14)} AS source, {_lines(12, 12)} AS signature FROM p WHERE contains('make_' || k, 'make_1') ORDER BY CASE WHEN 'make_' || k = 'make_1' THEN 0 ELSE 1 END, name, path LIMIT 10""")
def extract_by_name(spark, sf_dir):
    i = _index(spark, sf_dir)
    return symbols.extract_by_name(i.symbols, i.files, i.lines, "make_1").select("name", "path", "source", "signature")


@query(f"WITH {PARTS} SELECT 'make_7' AS name, {_lines(12, 14)} AS source FROM p WHERE k = 7 UNION ALL SELECT 'Part7', {_lines(5, 10)} FROM p WHERE k = 7")
def get_definition(spark, sf_dir):
    i = _index(spark, sf_dir)
    of = lambda name, *kinds: symbols.get_definition(i.symbols, i.files, i.lines, "src/m7.py", name, *kinds).select("name", "source")
    return of("make_7").unionByName(of("Part7", ("class",)))


@query(f"WITH {PARTS} SELECT 1::BIGINT AS candidates, {_lines(8, 10)} AS source, {_lines(5, 7)} AS preamble, {_lines(8, 8)} AS signature, 'make_7' AS callers, 'json,os.path,pkg.mod_' || s || ',sys' AS imports FROM p WHERE k = 7")
def edit_context(spark, sf_dir):
    out = symbols.edit_context(_index(spark, sf_dir), "price_7")
    joined = lambda c, glue: F.array_join(c, glue).alias(c)
    return out.select("candidates", "source", joined("preamble", "\n"), "signature", joined("callers", ","), joined("imports", ","))


@query(f"""WITH {PARTS} SELECT 'function' AS what, {_lines(12, 14)} AS value FROM p WHERE k = 7 UNION ALL SELECT 'line', {_lines(13, 13)} FROM p WHERE k = 7 UNION ALL SELECT 'types', 'price_7 scale float' UNION ALL SELECT 'types', 'price_7  float'
  UNION ALL SELECT 'imports', x FROM (SELECT unnest(['json', 'os.path', 'pkg.mod_' || s, 'sys']) AS x FROM p WHERE k = 7) UNION ALL SELECT 'callers', 'make_6'""")
def error_context(spark, sf_dir):
    i = _index(spark, sf_dir)
    line = 13 + parts(spark, sf_dir).filter("k = 7").select((F.col("s") % 4).cast("int")).first()[0]
    got = context.error_context(i, "TypeError in price_7", "src/m7.py", line)
    one = {"function": F.col("source"), "line": F.col("text"), "types": F.concat_ws(" ", "name", F.coalesce("param_name", F.lit("")), "annotation"), "imports": F.col("module"), "callers": F.col("caller_name")}
    frames = [got[k].select(F.lit(k).alias("what"), c.alias("value")) for k, c in one.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(f"WITH {PARTS} SELECT 'make_' || k AS name, {_lines(12, 14)} AS source FROM p WHERE contains('make_' || k, 'make_1') ORDER BY CASE WHEN 'make_' || k = 'make_1' THEN 0 ELSE 1 END, {PATHS} LIMIT 5")
def detect_original(spark, sf_dir):
    return context.detect_original(_index(spark, sf_dir), "def make_1(n):\n    return n\n", lang="python").select("name", "source")


@query(f"WITH {PARTS} SELECT 'price_7' AS name FROM p WHERE k = 7")
def enclosing(spark, sf_dir):
    i = _index(spark, sf_dir)
    return context.enclosing(i.symbols, i.files, "src/m7.py", 9).select("name")


def _texts() -> str:
    body = lambda a, b: f"regexp_replace({_lines(a, b)}, '\\s+', ' ', 'g')"
    kinds = {"class": f"'class Part' || k || ' Part ' || k || '. ' || trim({body(6, 9)} || CASE WHEN f > 0 THEN ' {FILL.strip()}' ELSE ' ' || trim({_lines(10, 10)}) END)"}
    kinds["price"] = f"'function price_' || k || ' Price of ' || k || '. ' || trim({body(9, 10)})"
    kinds["make"] = f"'function make_' || k || ' ' || trim({body(13, 14)})"
    kinds["square"] = "'function square_' || k"
    return _union(*[f"{n} AS name, {t} AS text" for (n, *_), t in zip(SYMBOLS, kinds.values())])


@query(_texts())
def symbol_texts(spark, sf_dir):
    i = _index(spark, sf_dir)
    return embed.symbol_texts(i).join(i.symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id").select("name", "text")


@query("SELECT 4 * count(*) AS total, 4 * count(*) AS with_vector, 0::BIGINT AS left_to_do FROM part")
def embedding_run(spark, sf_dir):
    i = _index(spark, sf_dir)
    done = written(embed.embed_symbols(i))
    return done.agg(F.count("*").alias("total"), F.count("embedding").alias("with_vector")).join(embed.embed_symbols(i, done).agg(F.count("*").alias("left_to_do")), F.lit(True))


# --- maintenance by change ------------------------------------------------------------------------------------------------------
def _changed(spark, sf_dir) -> ingest.Store:
    """A store of all parts in which small ones have changed (no fill, another size) and the largest have gone."""
    store = ingest.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    all_ = parts(spark, sf_dir)
    store.apply(all_.select("path", "content"))
    edited = all_.filter("s <= 10").select("path", F.replace("content", F.concat(F.lit("def make_"), F.col("k")), F.concat(F.lit("\n\ndef made_"), F.col("k"))).alias("content"))
    same = all_.filter("s between 11 and 20").select("path", "content")
    store.apply(edited.unionByName(same), all_.filter("s > 45").select("path"))
    return store


LEFT = "q AS (SELECT *, CASE WHEN s <= 10 THEN 2 ELSE 0 END AS e, CASE WHEN s <= 10 THEN 'made_' ELSE 'make_' END AS w FROM p WHERE s <= 45)"


@query(f"""WITH {PARTS}, {LEFT} SELECT {PATHS} AS path, 'Part' || k AS name, 5 AS line_start, 10 + f AS line_end FROM q UNION ALL SELECT {PATHS}, 'price_' || k, 8, 10 + f FROM q
  UNION ALL SELECT {PATHS}, w || k, 12 + f + e, 14 + f + e FROM q UNION ALL SELECT {PATHS}, 'square_' || k, 17 + f + e, 17 + f + e FROM q""")
def store_symbols(spark, sf_dir):
    i = _changed(spark, sf_dir).index(with_closure=False)
    return i.symbols.join(i.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "name", "line_start", "line_end")


@query(f"""WITH {PARTS}, {LEFT} SELECT a.w || a.k AS caller, 'make_' || (a.k + 1) AS callee, CASE WHEN b.k IS NOT NULL THEN 'src/m' || b.k || '.py' END AS file FROM q a LEFT JOIN q b ON b.k = a.k + 1 AND b.w = 'make_'""")
def store_edges(spark, sf_dir):
    i = _changed(spark, sf_dir).index(with_closure=False)
    named = i.call_edges.join(i.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
    return named.filter("callee_name like 'make%'").select("caller", F.col("callee_name").alias("callee"), F.col("callee_file").alias("file"))


@query(f"WITH {PARTS} SELECT {PATHS} AS path, CASE WHEN s <= 10 THEN 'changed' WHEN s > 45 THEN 'deleted' ELSE 'unchanged' END AS state FROM p UNION ALL SELECT 'src/new.py', 'new'")
def change_states(spark, sf_dir):
    old = parts(spark, sf_dir).select("path", "s", F.md5("content").alias("hash"))
    new = old.filter("s <= 45").select("path", F.when(F.col("s") <= 10, F.md5("hash")).otherwise(F.col("hash")).alias("hash"))
    return ingest.changes(old.drop("s"), new.unionByName(spark.createDataFrame([("src/new.py", "x")], "path string, hash string")))


@query(f"""WITH {PARTS}, {TOP}, q AS (SELECT * FROM p WHERE s <= 45) SELECT 'symbols' AS relation, 4 * count(*) AS n, 0::BIGINT AS resolved FROM q
  UNION ALL SELECT 'call_edges', 5 * count(*), (SELECT count(*) FROM q) + (SELECT count(*) FROM q a JOIN q b ON b.k = a.k + 1) FROM q UNION ALL SELECT 'files', count(*), 0 FROM q UNION ALL SELECT 'imports', 4 * count(*), 0 FROM q UNION ALL SELECT 'docstrings', 2 * count(*), 0 FROM q""")
def cascade(spark, sf_dir):
    i = _index(spark, sf_dir)
    gone = parts(spark, sf_dir).filter("s > 45").select("path").join(i.files, "path").select("id")
    left = ingest.cascade(i, gone)
    rows = [getattr(left, n).agg(F.lit(n).alias("relation"), F.count("*").alias("n"), (F.count("callee_id") if n == "call_edges" else F.lit(0)).cast("long").alias("resolved")) for n in ("symbols", "call_edges", "files", "imports", "docstrings")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id UNION ALL SELECT -1, 'kept'")
def upsert(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    old = e.select("user_id").distinct().withColumn("event_type", F.lit("old")).unionByName(spark.createDataFrame([(-1, "kept")], "user_id long, event_type string"))
    return ingest.upsert(old, e, ["user_id"], ["ts", "event_id"])


@query("SELECT 'u' || user_id || '.py' AS path, 'x = ' || max_by(event_id, struct_pack(t := ts, e := event_id)) AS content FROM events GROUP BY user_id HAVING max_by(event_type, struct_pack(t := ts, e := event_id)) <> 'error'")
def stream_maintain(spark, sf_dir):
    base = f"{shared_dir(spark)}/maintain-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = F.concat(F.lit("u"), F.col("user_id"), F.lit(".py"))
    rows = e.select("event_id", "ts", path.alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("op"), F.lit(None).cast("string").alias("dest"), F.concat(F.lit("x = "), F.col("event_id").cast("string")).alias("content"))
    rows.write.parquet(f"{base}/changes")
    changes.maintain(spark, f"{base}/changes", f"{base}/store", f"{base}/checkpoint").awaitTermination()
    store = ingest.Store(spark, f"{base}/store")
    return store.live("files").select("path", "content")


@query("SELECT user_id AS symbol_id, event_type AS commit_hash, min(event_id) AS id FROM events GROUP BY user_id, event_type")
def first_commit(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("symbol_id"), F.col("event_type").alias("commit_hash"))
    return history.first_per_commit(e).select("symbol_id", "commit_hash", "id")


# --- other languages --------------------------------------------------------------------------------------------------------------
#: By supplier key % 5: language, text and (name, kind, first and last line) of its symbols, and the line of its call to h_{k}.
OTHER = (
    ("javascript", "const add_{k} = (a, b) => a + b;\n\n/** Named {k}. */\nfunction named_{k}() {\n  return h_{k}(1, 2);\n}\n\nclass C{k} {\n}\n", (("add_", "function", 1, 1), ("named_", "function", 4, 6), ("C", "class", 8, 9)), 5),
    ("java", "import java.util.List{k};\n\npublic class S{k} {\n  Runnable task_{k} = () -> run();\n  public void work_{k}() {\n    h_{k}();\n  }\n}\n", (("S", "class", 3, 8), ("task_", "function", 4, 4), ("work_", "method", 5, 7)), 6),
    ("go", 'package main\n\nimport "fmt{k}"\n\nfunc run_{k}() {\n\th_{k}()\n}\n\ntype T{k} struct {\n}\n', (("run_", "function", 5, 7), ("T", "class", 9, 10)), 6),
    ("rust", "use std::fmt{k};\n\npub fn main_{k}() -> i32 {\n    let add_{k} = |a, b| a + b;\n    h_{k}()\n}\n\nstruct Z{k} {\n}\n", (("main_", "function", 3, 6), ("add_", "function", 4, 4), ("Z", "class", 8, 9)), 5),
    ("typescript", "const double_{k} = (n: number): number => n * 2;\nclass D{k} {\n  get_{k}(x: number): number {\n    return h_{k}(x);\n  }\n}\n", (("double_", "function", 1, 1), ("D", "class", 2, 6), ("get_", "method", 3, 5)), 4),
)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    pick = lambda n: F.element_at(F.array(*[F.lit(o[n]) for o in OTHER]), (key % len(OTHER) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("id"), pick(0).alias("lang"), F.replace(pick(1), F.lit("{k}"), key.cast("string")).alias("content"))


@query(" UNION ALL ".join(f"SELECT s_suppkey AS file_id, '{n}' || s_suppkey AS name, '{kind}' AS kind, {a} AS line_start, {b} AS line_end FROM supplier WHERE s_suppkey % 5 = {m}" for m, o in enumerate(OTHER) for n, kind, a, b in o[2]))
def parsed_others(spark, sf_dir):
    return extract.extract(suppliers(spark, sf_dir)).filter("fact = 'symbol'").select("file_id", "name", "kind", "line_start", "line_end")


@query(" UNION ALL ".join(f"SELECT s_suppkey AS file_id, 'h_' || s_suppkey AS name, {o[3]} AS line FROM supplier WHERE s_suppkey % 5 = {m}" for m, o in enumerate(OTHER)))
def parsed_other_calls(spark, sf_dir):
    return extract.extract(suppliers(spark, sf_dir)).filter("fact = 'call' and name like 'h!_%' escape '!'").select("file_id", "name", F.col("line_start").alias("line"))


@query(" UNION ALL ".join(f"SELECT s_suppkey AS file_id, '{n}' || s_suppkey AS module FROM supplier WHERE s_suppkey % 5 = {m}" for m, n in ((1, "java.util.List"), (2, "fmt"), (3, "std::fmt"))))
def parsed_other_imports(spark, sf_dir):
    return extract.extract(suppliers(spark, sf_dir)).filter("fact = 'import'").select("file_id", F.col("name").alias("module"))


@query("SELECT s_suppkey AS file_id, 'Named ' || s_suppkey || '.' AS content FROM supplier WHERE s_suppkey % 5 = 0")
def parsed_other_docs(spark, sf_dir):
    return extract.extract(suppliers(spark, sf_dir)).filter("fact = 'docstring'").select("file_id", F.col("detail").alias("content"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'java' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' ELSE 'javascript' END AS lang FROM supplier")
def guessed_language(spark, sf_dir):
    return suppliers(spark, sf_dir).select("id", scan.guess_language(F.col("content")).alias("lang"))


# --- edits ------------------------------------------------------------------------------------------------------------------------
BODY = "def f_{k}(a):\n    x = {s}\n    y = x + 1\n    return y\n\ntail_{k}\n"
BODY_SQL = "'def f_' || k || '(a):' || chr(10) || '    x = ' || s || chr(10) || '    y = x + 1' || chr(10) || '    return y' || chr(10) || chr(10) || 'tail_' || k || chr(10)"
TWO = "'    x = ' || s || chr(10) || '    y = x + 1'"
FOUR = "'def f_' || k || '(a):' || chr(10) || " + TWO + " || chr(10) || '    return y'"
#: (case, text to find, SQL of what it stands for in BODY): one for each way to match.
CASES = (
    ("exact", "    x = {s}\n    y = x + 1", TWO), ("line_trimmed", "x = {s}\ny = x + 1", TWO), ("block_anchor", "def f_{k}(a):\n    x = {s}\n    y = x + 2\n    return y", FOUR), ("whitespace_normalized", "x  =   {s}", "'    x = ' || s"),
    ("indentation_flexible", "        x = {s}\n        y = x + 1", TWO), ("escape_normalized", "    x = {s}\\n    y = x + 1", TWO), ("trimmed_boundary", "\n\ntail_{k}\n\n", "'tail_' || k"), ("context_aware", "def f_{k}(a):\n    x = {s}\n    zzzzzzzzzzzzzzzzzz\n    return y", FOUR),
    ("multi_occurrence", "x", "'x'"),
)


def _cases(spark, sf_dir) -> DataFrame:
    p = parts(spark, sf_dir).select("k", "s")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), _filled(find).alias("find")) for c, find, _ in CASES])).alias("c")
    return p.select("k", "s", _filled(BODY).alias("content"), each).select("k", "content", "c.case", "c.find")


@query(" UNION ALL ".join(f"SELECT k, '{c}' AS \"case\", {found} AS found, {2 if c == 'multi_occurrence' else 1} AS n FROM p" for c, _, found in CASES).join([f"WITH {PARTS} ", ""]))
def edit_matchers(spark, sf_dir):
    @F.pandas_udf("array<string>")
    def run(case: pd.Series, content: pd.Series, find: pd.Series) -> pd.Series:
        return pd.Series([list(getattr(textops, m)(c, f)) for m, c, f in zip(case, content, find)])

    hits = run("case", "content", "find")
    return _cases(spark, sf_dir).select("k", "case", hits.alias("h")).select("k", "case", F.get("h", F.lit(0)).alias("found"), F.size("h").alias("n"))


def _edits(spark, sf_dir) -> DataFrame:
    rows = _cases(spark, sf_dir).select("k", "case", F.concat(F.lit("f"), F.col("k")).alias("path"), "content", F.col("find").alias("old_code"), F.lit("    z = 0").alias("new_code"))
    return textops.preview_edits(rows)


@query(f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT k, '{c}' AS \"case\", " + ("NULL AS new_content, 'the text to replace occurs more than once' AS error" if c == "multi_occurrence" else f"replace({BODY_SQL}, {found}, '    z = 0') AS new_content, NULL AS error") + " FROM p" for c, _, found in CASES))
def fuzzy_edits(spark, sf_dir):
    return _edits(spark, sf_dir).select("k", "case", "preview.new_content", "preview.error")


@query(f"""WITH {PARTS} SELECT k, '--- a/f' || k || chr(10) || '+++ b/f' || k || chr(10) || '@@ -1,6 +1,5 @@' || chr(10) || ' def f_' || k || '(a):' || chr(10) || '-    x = ' || s || chr(10) || '-    y = x + 1' || chr(10) || '+    z = 0' || chr(10)
  || '     return y' || chr(10) || ' ' || chr(10) || ' tail_' || k || chr(10) AS diff, 3 AS lines_changed FROM p""")
def edit_previews(spark, sf_dir):
    return _edits(spark, sf_dir).filter("case = 'exact'").select("k", "preview.diff", "preview.lines_changed")


GUARDS = (("lines below", 1, 2, 3, False), ("lines at", 1, 2, 4, True), ("four for one", 1, 2, 4, True), ("long line", 1, 900, 1, False), ("long lines", 3, 900, 3, True), ("five for three", 3, 2, 5, False), ("six for three", 3, 2, 6, True))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(r).lower()})" for n, *_, r in GUARDS) + ") AS t(name, refused)")
def edit_guard(spark, sf_dir):
    """Texts of `want` lines of one character, matches of `lines` lines of `size` characters each."""
    rows = spark.createDataFrame([(n, "\n".join(["a"] * want), "\n".join(["b" * size] * lines)) for n, want, size, lines, _ in GUARDS], "name string, want string, found string")

    @F.pandas_udf("boolean")
    def run(found: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([textops.disproportionate(f, w) for f, w in zip(found, want)])

    return rows.select("name", run("found", "want").alias("refused"))


@query(f"WITH {PARTS} SELECT k, 0 AS first, 3 AS last FROM p")
def best_match(spark, sf_dir):
    @F.pandas_udf("first int, last int, similarity double")
    def run(find: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([textops.best_match(f, c) or (None, None, None) for f, c in zip(find, content)], columns=["first", "last", "similarity"])

    return _cases(spark, sf_dir).filter("case = 'block_anchor'").select("k", run("find", "content").alias("m")).select("k", "m.first", "m.last")


@query("SELECT event_type AS file_path, count(*) AS n, count(DISTINCT user_id) AS pending FROM events GROUP BY event_type")
def edit_log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("old_code"), F.lit("n").alias("new_code"), F.struct(F.lit("d").alias("diff"), F.lit(None).cast("string").alias("error")).alias("preview"))
    edits = textops.edit_rows(rows)
    return edits.groupBy("file_path").agg(F.count("*").alias("n")).join(textops.latest_edits(edits).filter("not applied").groupBy("file_path").agg(F.count("*").alias("pending")), "file_path")


# --- blocks into files ----------------------------------------------------------------------------------------------------------------
#: (case, snippet, SQL of the file after it, what was done)
MERGES = (
    ("function", 'def make_{k}(n: int, label="x"):\n    return n', f"{_lines(1, 11)} || chr(10) || {_lines(12, 12)} || chr(10) || '    return n' || chr(10) || {_lines(15, 17)} || chr(10)", "replaced"),
    ("method", "def price_{k}(self):\n    return 1", f"{_lines(1, 7)} || chr(10) || '    def price_' || k || '(self):' || chr(10) || '        return 1' || chr(10) || {_lines(11, 17)} || chr(10)", "replaced"),
    ("import", "import re\nimport json", f"{_lines(1, 3)} || chr(10) || 'import re' || chr(10) || {_lines(4, 17)} || chr(10)", "merged,unchanged"),
    ("constant", "LIMIT_{k} = 0", f"{_lines(1, 15)} || chr(10) || 'LIMIT_' || k || ' = 0' || chr(10) || {_lines(17, 17)} || chr(10)", "replaced"),
    ("new", "def extra_{k}():\n    pass", f"{_lines(1, 17)} || chr(10) || chr(10) || 'def extra_' || k || '():' || chr(10) || '    pass' || chr(10)", "appended"),
)


@query(f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT k, '{c}' AS \"case\", {text} AS content, '{done}' AS done FROM p" for c, _, text, done in MERGES))
def apply_blocks(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), _filled(code).alias("code")) for c, code, *_ in MERGES])).alias("c")

    @F.pandas_udf("content string, done string")
    def run(content: pd.Series, code: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = [blocks.apply_code(c, x, p) for c, x, p in zip(content, code, path)]
        return pd.DataFrame([(t, ",".join(a for _, _, a in done)) for t, done in out], columns=["content", "done"])

    return parts(spark, sf_dir).select("k", "path", "content", "s", each).select("k", F.col("c.case").alias("case"), run("content", "c.code", "path").alias("r")).select("k", "case", "r.*")


@query(_union("k, 'imports' AS what, 0 AS first, 4 AS stop", "k, 'indented', 7, 10 + f", "k, 'constant', 15 + f, 16 + f", "k, 'function', 11 + f, 14 + f", "k, 'class', 4, 10 + f"))
def block_bounds(spark, sf_dir):
    @F.pandas_udf("array<struct<what:string,first:int,stop:int>>")
    def run(content: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for c, n in zip(content, k):
            lines = c.split("\n")
            out.append([("imports", *blocks.import_section(lines)), ("indented", *blocks.indented_bounds(lines, f"price_{n}", "function", f"Part{n}")), ("constant", *blocks.constant_bounds(lines, f"LIMIT_{n}")),
                        ("function", *blocks.find_bounds(c, f"make_{n}", "function", "a.py")), ("class", *blocks.find_bounds(c, f"Part{n}", "class", "a.py"))])
        return pd.Series(out)

    return parts(spark, sf_dir).select("k", F.explode(run("content", "k")).alias("b")).select("k", "b.*")


@query(f"WITH {PARTS} SELECT k, 'Part' || k AS class_name FROM p")
def class_context(spark, sf_dir):
    @F.pandas_udf("string")
    def run(content: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([blocks.class_context(c, f"price_{n}") for c, n in zip(content, k)])

    return parts(spark, sf_dir).select("k", run("content", "k").alias("class_name"))


# --- tool output ------------------------------------------------------------------------------------------------------------------
def _output(spark, sf_dir, form: str) -> DataFrame:
    """id, raw: `form` with the event's id, user, line (id % 50 + 1) and column (id % 9 + 1) in it."""
    raw = F.lit(form)
    for mark, c in (("{id}", F.col("event_id")), ("{u}", F.col("user_id")), ("{l}", F.col("event_id") % 50 + 1), ("{c}", F.col("event_id") % 9 + 1)):
        raw = F.replace(raw, F.lit(mark), c.cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), raw.alias("raw"))


def _finding(file: str, severity: str, code: str, message: str, col: str = "event_id % 9 + 1") -> str:
    return f"SELECT event_id AS id, {file} AS file, event_id % 50 + 1 AS line, {col} AS col, '{severity}' AS severity, {code} AS code, {message} AS message FROM events"


@query(_finding("'src/f' || user_id || '.ts'", "error", "'TS23'", "'no ' || event_id || ': x'"))
def log_tsc(spark, sf_dir):
    return logs.parse_tsc(_output(spark, sf_dir, "tsc 5\nsrc/f{u}.ts({l},{c}): error TS23: no {id}: x\nFound 1 error.")).drop("pos")


@query(_finding("'/a/F' || user_id || '.java'", "error", "''", "'no ' || event_id"))
def log_maven(spark, sf_dir):
    return logs.parse_maven(_output(spark, sf_dir, "[INFO] x\n[ERROR] /a/F{u}.java:[{l},{c}] no {id}\n[ERROR] BUILD FAILURE\n[ERROR] ")).drop("pos")


@query(_finding("'./f' || user_id || '.go'", "error", "''", "'no ' || event_id"))
def log_go(spark, sf_dir):
    return logs.parse_go(_output(spark, sf_dir, "# pkg\n./f{u}.go:{l}:{c}: no {id}\nFAIL")).drop("pos")


@query(_finding("'src/f' || user_id || '.rs'", "warning", "'E7'", "'no ' || event_id"))
def log_cargo(spark, sf_dir):
    line = '{"reason":"compiler-message","message":{"message":"no {id}","level":"warning","code":{"code":"E7"},"spans":[{"file_name":"o.rs","line_start":1,"column_start":1,"is_primary":false},{"file_name":"src/f{u}.rs","line_start":{l},"column_start":{c},"is_primary":true}]}}'
    return logs.parse_cargo(_output(spark, sf_dir, '{"reason":"build-finished","success":true}\n' + line + "\nplain")).drop("pos")


@query(_finding("'src/f' || user_id || '.py'", "warning", "'W291'", "'no ' || event_id"))
def log_ruff_json(spark, sf_dir):
    return logs.parse_ruff(_output(spark, sf_dir, ' [{"filename":"src/f{u}.py","code":"W291","message":"no {id}","location":{"row":{l},"column":{c}},"x":1}]')).drop("pos")


@query("SELECT event_id AS id, (event_id % 50 + 1)::INT AS passed, (event_id % 9 + 1)::INT AS failed, 0 AS errors, 't/t' || user_id || '.py::test_x - no' AS failures, 'E   assert ' || event_id AS traceback FROM events")
def log_pytest(spark, sf_dir):
    out = logs.parse_pytest(_output(spark, sf_dir, "1 passed so far\nE   assert {id}\nFAILED t/t{u}.py::test_x - no\n== {c} failed, {l} passed in 1s =="))
    return out.select("id", "passed", "failed", "errors", F.array_join("failures", "|").alias("failures"), F.array_join("traceback", "|").alias("traceback"))


@query("SELECT event_id AS id, 2 AS passed, 1 AS failed, 2 AS errors FROM events")
def log_counts(spark, sf_dir):
    return logs.count_outcomes(_output(spark, sf_dir, "ok {id}\nPASSED a\nfailed b\nerror c, 2 errors\nbroken tokens"))


@query("SELECT event_id AS id FROM events WHERE user_id = 7")
def log_only_file(spark, sf_dir):
    return logs.only_file(logs.parse_tsc(_output(spark, sf_dir, "src/f{u}.ts({l},{c}): error TS1: x")), "src/f7.ts").select("id")


@query("SELECT event_id AS id, 'rule-' || event_id AS rule, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'view' THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'f' || user_id || '.py' AS file, event_id % 50 + 1 AS line_start, 0.8::DOUBLE AS confidence FROM events")
def scan_findings(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "warning").otherwise("INFO")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.format_string('{"results":[{"check_id":"a.b.rule-%d","path":"f%d.py","start":{"line":%d,"col":1},"end":{"line":9,"col":2},"extra":{"message":"m","severity":"%s","lines":"x"}}]}', "event_id", "user_id", F.col("event_id") % 50 + 1, level).alias("value"))
    return scan.scan_findings(raw).select(F.substring("rule", 6, 20).cast("long").alias("id"), "rule", "severity", "file", "line_start", "confidence")


@query("SELECT count(*) AS n_findings, count(DISTINCT user_id) AS n_files FROM events")
def finding_summary(spark, sf_dir):
    return scan.finding_summary(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("f"), F.col("user_id")).alias("file")))


# --- history, paths, text -------------------------------------------------------------------------------------------------------------
@query("SELECT md5(event_id::VARCHAR) AS commit_hash, strftime(ts, '%Y-%m-%d') AS commit_date, event_type || ' | ' || event_id AS commit_msg FROM events")
def commit_log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.explode(F.array(F.concat_ws("|", F.md5(F.col("event_id").cast("string")), F.date_format("ts", "yyyy-MM-dd"), F.concat("event_type", F.lit(" | "), F.col("event_id").cast("string"))), F.lit("no commit"))).alias("value"))
    return history.parse_log(rows)


@query("SELECT event_id, (event_id % 50 + 1)::INT AS start, CASE WHEN event_type = 'click' THEN 1 ELSE (user_id + 2)::INT END AS count FROM events")
def hunk_headers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    new = F.when(F.col("event_type") == "click", F.format_string("+%d", F.col("event_id") % 50 + 1)).otherwise(F.format_string("+%d,%d", F.col("event_id") % 50 + 1, F.col("user_id") + 2))
    return e.select("event_id", history.hunk_range(F.concat(F.lit("@@ -3,4 "), new, F.lit(" @@ def f():"))).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'deleted' WHEN 'error' THEN 'signature_change' ELSE 'logic_edit' END AS change FROM events")
def change_types(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    none, head = F.array().cast("array<string>"), lambda x: F.array(F.concat(F.lit(x), F.col("user_id").cast("string")), F.lit("  y"))
    old = F.when(F.col("event_type") == "view", none).otherwise(head("def f"))
    new = F.when(F.col("event_type") == "click", none).when(F.col("event_type") == "error", head("def g")).otherwise(head("  def f"))
    return e.select("event_id", history.classify_change(old, new).alias("change"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM documents")
def normalized_space(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", textops.normalize_space(F.col("text")).alias("text"))


EVENT_PATHS = "CASE event_type WHEN 'view' THEN 'a/b' || user_id || '.py' WHEN 'click' THEN 'node_modules/x' || user_id || '.js' WHEN 'error' THEN 'w/.git/c' || user_id WHEN 'signup' THEN 'w/Main' || user_id || '.JAVA' ELSE 'x.egg-info/t' || user_id || '.rs' END"


def _event_paths(spark, sf_dir) -> DataFrame:
    u = F.col("user_id").cast("string")
    form = {"view": ("a/b", ".py"), "click": ("node_modules/x", ".js"), "error": ("w/.git/c", ""), "signup": ("w/Main", ".JAVA"), "purchase": ("x.egg-info/t", ".rs")}
    path = F.coalesce(*[F.when(F.col("event_type") == k, F.concat(F.lit(a), u, F.lit(b))) for k, (a, b) in form.items()])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(path.alias("path")).distinct().withColumn("lang", scan.detect_language(F.col("path")))


@query(f"SELECT DISTINCT {EVENT_PATHS} AS path, CASE event_type WHEN 'view' THEN 'python' WHEN 'click' THEN 'javascript' WHEN 'signup' THEN 'java' WHEN 'purchase' THEN 'rust' END AS lang, event_type IN ('click', 'error') AS not_indexed, event_type IN ('click', 'error', 'purchase') AS not_searched FROM events")
def path_kinds(spark, sf_dir):
    return _event_paths(spark, sf_dir).select("path", "lang", scan.in_skipped(F.col("path")).alias("not_indexed"), scan.in_skipped(F.col("path"), scan.SEARCH_SKIP).alias("not_searched"))


@query("SELECT CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'node_modules' WHEN 'purchase' THEN 'x.egg-info' ELSE 'w' END AS directory, bool_or(event_type = 'error') AS has_git, count(DISTINCT user_id) FILTER (event_type <> 'error') AS n_files FROM events GROUP BY 1")
def workspace(spark, sf_dir):
    return scan.list_workspace(_event_paths(spark, sf_dir))


@query(f"SELECT DISTINCT 1 AS depth, split_part({EVENT_PATHS}, '/', 1) AS name, false AS is_file FROM events UNION SELECT DISTINCT 2, '.git', false FROM events WHERE event_type = 'error' UNION SELECT DISTINCT CASE WHEN event_type = 'error' THEN 3 ELSE 2 END, split_part({EVENT_PATHS}, '/', -1), true FROM events")
def directory_tree(spark, sf_dir):
    return scan.tree(_event_paths(spark, sf_dir)).select("depth", "name", "is_file")


@query("SELECT 'python' AS stack")
def stack(spark, sf_dir):
    return scan.detect_stack(_event_paths(spark, sf_dir).select("path").unionByName(spark.createDataFrame([("requirements.txt",), ("Makefile",), ("sub/pom.xml",)], "path string")))


def _doc_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), F.lit("python").alias("lang"))
    return d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("file_id", (F.col("p") + 1).alias("line_no"), "text"), files


DOC_LINES = "l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS text, len(string_split(text, chr(10))) AS n FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query(f"WITH {DOC_LINES} SELECT string_agg(i || ': ' || text, chr(10) ORDER BY i) AS content FROM l WHERE doc_id = 16 AND i BETWEEN 2 AND 5")
def read_file(spark, sf_dir):
    return textsearch.read_file(*_doc_files(spark, sf_dir), "d/16", 2, 5)


@query(f"WITH {DOC_LINES} SELECT p AS position, w AS line, text AS content, CASE WHEN text IS NULL THEN 'out of range' END AS error FROM (VALUES (0, 3), (1, 1), (2, 100000), (3, 3)) AS a(p, w) LEFT JOIN l ON l.doc_id = 16 AND l.i = w")
def read_scattered(spark, sf_dir):
    return textsearch.read_scattered(*_doc_files(spark, sf_dir), "d/16", [3, 1, 100_000, 3])


@query(f"""WITH {DOC_LINES}, m AS (SELECT a.doc_id, a.i, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.i) AS r, length(a.text) - 1 AS col FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.i = a.i + 1 WHERE a.text LIKE '%.' AND b.text LIKE 'T%')
  SELECT 'd/' || doc_id AS file, i AS line, col, '.' || chr(10) || 'T' AS text FROM m WHERE r <= 20 ORDER BY file, line LIMIT 100000""")
def grep_multiline(spark, sf_dir):
    return textsearch.search_code(*_doc_files(spark, sf_dir), ".\nT", limit=100_000)


@query(f"WITH {PARTS} SELECT {PATHS} AS file, 12 + f AS line FROM p WHERE k = 7 UNION ALL SELECT {PATHS}, 1 FROM p WHERE false")
def symbol_or_grep(spark, sf_dir):
    i = _index(spark, sf_dir)
    hits = textsearch.symbol_or_grep(i.lines, i.files, i.symbols, "def make_7(n):").select("file", "line")
    return hits.unionByName(textsearch.symbol_or_grep(i.lines, i.files, i.symbols, "class Nothing(x):").select("file", "line"))


@query(f"WITH {PARTS} SELECT 12 + f AS window_start, 13 + f AS window_end, true AS has_more, 14 + f AS next_window_start, {_lines(12, 13)} AS body FROM p WHERE k = 7")
def function_body(spark, sf_dir):
    i = _index(spark, sf_dir)
    start = 12 + parts(spark, sf_dir).filter("k = 7").select((F.col("s") % 4).cast("int")).first()[0]
    return symbols.function_body(i.lines, i.files, "src/m7.py", start, start + 2, max_lines=2)


@query("SELECT (p_partkey - 6)::INT AS depth, 1::BIGINT AS n_callers, 0::BIGINT AS total, 'make_' || p_partkey AS callers FROM part WHERE false UNION ALL SELECT (7 - p_partkey)::INT, 1, 7, 'make_' || p_partkey FROM part WHERE p_partkey < 7")
def caller_depths(spark, sf_dir):
    i = _index(spark, sf_dir)
    near = graph.closure(graph.live_edges(i).join(i.symbols.filter("name like 'make!_%' escape '!'").select(F.col("id").alias("callee_id"), F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("k")), "callee_id").filter("k <= 7").drop("k"))
    return graph.blast_radius(near, i.symbols, i.files, "make_7").select("depth", "n_callers", F.col("total_affected").alias("total"), F.transform("callers", lambda c: c["name"])[0].alias("callers"))


GUARDED = ("blank symbol", "unknown scope", "lines from 0", "bad pattern", "unknown edit mode", "write through the door", "java through the door")


@query("SELECT unnest([" + ", ".join(f"'{g}'" for g in GUARDED) + "]) AS name, true AS refused")
def guards(spark, sf_dir):
    from tarnwell.plans import sqldoor

    lines, files = _doc_files(spark, sf_dir)
    calls = (lambda: symbols.find_usages(lines, files, files, " "), lambda: audit.find_unused(None, "all"), lambda: textsearch.read_lines(lines, files, "d/1", 0), lambda: textsearch.grep_file(lines, files, "d/1", "("),
             lambda: textops.preview_edits(files, "other"), lambda: sqldoor.run_query(spark, "DROP TABLE x"), lambda: sqldoor.run_query(spark, "SELECT reflect('java.lang.System', 'exit', 1)"))
    rows = []
    for name, call in zip(GUARDED, calls):
        try:
            call()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")
