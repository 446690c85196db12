"""One query for each operator over the test tables, with the same in SQL for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import logs, textops
from tarnwell.operators import audit, deps, graph, history, resolve, symbols, textsearch, vector
from tarnwell.plans import sqldoor
from tarnwell.plans.derive import derive, sql
from tarnwell.sources import scan
from tarnwell.sources.store import shared_dir
from tarnwell.streaming import changes, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Arguments of the queries.
NAME, CALLEE, CALLER, PATH = "the", "the", "the", "src16/en/doc_16.py"
ROOT, START = "onon", "aich"


def query(oracle: str | None = None, recursive: bool = False):
    """Registers a function of (index) or, with two arguments, of (spark, sf_dir)."""

    def wrap(f):
        name = f.__name__
        QUERIES[name] = f if f.__code__.co_argcount == 2 else (lambda spark, sf_dir: f(derive(spark, sf_dir)))
        if oracle:
            ORACLE[name] = sql(oracle, recursive)
        return f

    return wrap


# --- relations -----------------------------------------------------------------------------------------------------------
@query("SELECT id, path, lang, mtime, hash FROM files")
def files(i):
    return i.files


@query("SELECT file_id, line_no, text FROM lines")
def lines(i):
    return i.lines


@query("SELECT id, file_id, name, kind, line_start, line_end, qualified_name FROM symbols")
def symbols_table(i):
    return i.symbols


@query("SELECT file_id, line, pos, callee_name FROM calls")
def calls(i):
    return i.calls


@query("SELECT id, file_id, module, level, is_star FROM imports")
def imports(i):
    return i.imports


@query("SELECT file_id, line, pos, callee_name, caller_id FROM enclosed")
def enclosing_symbol(i):
    return resolve.enclosing_symbol(i.calls, i.symbols)


@query("SELECT caller_id, callee_name, line, pos, callee_id, resolved_name, callee_file FROM call_edges")
def resolve_calls(i):
    return i.call_edges


@query("SELECT symbol_id, file_id, line FROM symbol_references")
def references_last(i):
    return i.symbol_references


@query("""SELECT coalesce(o.id, u.id) AS symbol_id, t.file_id, t.line FROM tokens t
  LEFT JOIN (SELECT file_id, name, min(id) AS id FROM symbols GROUP BY file_id, name) o ON o.file_id = t.file_id AND o.name = t.name
  LEFT JOIN (SELECT name, min(id) AS id FROM symbols GROUP BY name HAVING count(*) = 1) u ON u.name = t.name WHERE coalesce(o.id, u.id) IS NOT NULL""")
def references_near(i):
    tokens = i.lines.select("file_id", F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))).alias("name"))
    return resolve.references_near(tokens.withColumn("name", F.lower("name")), i.symbols)


# --- symbols -------------------------------------------------------------------------------------------------------------
RANK = f"CASE WHEN s.name = '{NAME}' THEN 0 WHEN s.name ILIKE '{NAME}%' THEN 1 ELSE 2 END"
ENTRY = "s.name || ':' || substr(s.kind, 1, 1) || ':' || path || ':' || s.line_start || '-' || s.line_end"


@query(f"SELECT s.name, s.kind, path, s.line_start, s.line_end, {RANK} AS rank, {ENTRY} AS entry FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name ILIKE '%{NAME}%' ORDER BY rank, s.name, path, s.line_start, s.id LIMIT 50")
def symbol_search_ranked(i):
    return symbols.search_symbol(i.symbols, i.files, NAME).drop("id", "file_id")


@query(f"SELECT s.name, s.kind, path, s.line_start, s.line_end, {RANK} AS rank, {ENTRY} AS entry FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name ILIKE '%{NAME}%' AND kind = 'method' AND lower(path) LIKE 'src1/%' ORDER BY rank, s.name, path, s.line_start, s.id LIMIT 20")
def symbol_search_filtered(i):
    return symbols.search_symbol(i.symbols, i.files, NAME, kind="method", directory="src1/", limit=20).drop("id", "file_id")


@query(f"SELECT {ENTRY} AS entry, s.name, s.kind, path AS file, s.line_start, s.line_end FROM symbols s JOIN files f ON f.id = s.file_id WHERE lower(path) LIKE 'src2/en/%' OR lower(path) LIKE '%/src2/en/%'")
def compact_entries(i):
    rows = i.symbols.join(i.files.select(F.col("id").alias("file_id"), "path"), "file_id").filter(symbols.path_filter(F.col("path"), package="src2.en"))
    rows = rows.select(symbols.compact().alias("entry"))
    return rows.select("entry", symbols.parse_compact(F.col("entry")).alias("p")).select("entry", "p.*")


@query("SELECT path, lang, count(s.id) AS n_symbols, any_value(n) AS n_lines FROM files f LEFT JOIN symbols s ON s.file_id = f.id LEFT JOIN (SELECT file_id, count(*) AS n FROM lines GROUP BY file_id) l ON l.file_id = f.id GROUP BY path, lang")
def repo_summary(i):
    return symbols.repo_summary(i.symbols, i.files, i.lines)


@query("SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'javascript' ELSE 'go' END AS language, count(*) AS n FROM files GROUP BY 1")
def index_summary_languages(i):
    return symbols.language_histogram(i.files, scan.SUFFIX_LANGUAGES)


@query("SELECT split_part(path, '/', 1) AS directory, count(DISTINCT f.id) AS n_files, count(s.id) AS n_symbols FROM files f LEFT JOIN symbols s ON s.file_id = f.id GROUP BY 1")
def index_summary_directories(i):
    return symbols.directory_stats(i.symbols, i.files)


@query("SELECT path, count(*) AS n_symbols FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY path ORDER BY n_symbols DESC, path LIMIT 10")
def index_summary_top_files(i):
    return symbols.top_files(i.symbols, i.files)


@query("SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def index_summary_kinds(i):
    return symbols.kind_histogram(i.symbols)


PAGE = "SELECT id AS file_id, path FROM files WHERE id IN (SELECT file_id FROM symbols) AND path ILIKE '%/de/%' ORDER BY path LIMIT 20 OFFSET 10"


@query(f"SELECT p.path, s.name, s.kind, s.line_start, s.line_end, (SELECT count(*) FROM files WHERE path ILIKE '%/de/%' AND id IN (SELECT file_id FROM symbols)) AS total_files FROM ({PAGE}) p JOIN symbols s ON s.file_id = p.file_id")
def index_page(i):
    rows = symbols.index_page(i.symbols, i.files, query="/de/", limit=20, offset=10)
    return rows.select("path", F.explode("symbols").alias("s"), "total_files").select("path", "s.name", "s.kind", "s.line_start", "s.line_end", "total_files")


@query("""SELECT caller_name || '@' || caller_line AS caller, string_agg(callee_name, ', ' ORDER BY cf, l, p, callee_name) AS callees FROM (
  SELECT caller_name, caller_line, callee_name, (min(struct_pack(f := caller_file, l := line, p := pos))).f AS cf, (min(struct_pack(f := caller_file, l := line, p := pos))).l AS l, (min(struct_pack(f := caller_file, l := line, p := pos))).p AS p
  FROM edge_view WHERE lower(caller_file) LIKE 'src5/en/%' OR lower(callee_file) LIKE 'src5/en/%' GROUP BY caller_name, caller_line, callee_name) GROUP BY caller_name, caller_line""")
def overview_edges(i):
    return symbols.repo_overview(i.symbols, i.files, graph.edge_view(i), directory="src5/en", limit=1_000_000)[1]


@query("""SELECT path, string_agg(name || ':' || substr(kind, 1, 1) || ':' || line_start || '-' || line_end, ' ' ORDER BY line_start, name, kind) AS symbols, (SELECT count(*) FROM files WHERE lower(path) LIKE 'src5/en/%') AS total_files
  FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.id IN (SELECT id FROM files WHERE lower(path) LIKE 'src5/en/%' ORDER BY path LIMIT 5) GROUP BY path""")
def overview_files(i):
    return symbols.repo_overview(i.symbols, i.files, graph.edge_view(i), directory="src5/en", limit=5)[0].drop("has_more")


@query(f"SELECT s.name, s.kind, s.line_start, s.line_end, count(*) OVER () AS total FROM symbols s JOIN files f ON f.id = s.file_id WHERE path = '{PATH}'")
def file_overview(i):
    return symbols.file_overview(i.symbols, i.files, PATH)


@query("""SELECT s.id, s.name, s.kind, string_agg(l.text, chr(10) ORDER BY l.line_no) AS source FROM symbols s JOIN lines l ON l.file_id = s.file_id AND l.line_no BETWEEN s.line_start AND s.line_end
  WHERE s.kind = 'method' GROUP BY s.id, s.name, s.kind""")
def symbol_sources(i):
    return symbols.with_source(i.symbols.filter("kind = 'method'"), i.lines).select("id", "name", "kind", "source")


@query("""SELECT s.id, s.name, s.kind, string_agg(l.text, chr(10) ORDER BY l.line_no) AS source FROM symbols s JOIN lines l ON l.file_id = s.file_id AND l.line_no BETWEEN s.line_start AND s.line_end
  GROUP BY s.id, s.name, s.kind""")
def symbol_sources_all(i):
    return symbols.with_source(i.symbols, i.lines).select("id", "name", "kind", "source")


@query(f"SELECT s.name, s.kind, path, r.line FROM symbol_references r JOIN symbols s ON s.id = r.symbol_id JOIN files f ON f.id = r.file_id WHERE s.name = '{NAME}' ORDER BY path, line, s.id LIMIT 50")
def usages(i):
    return symbols.find_usages(i.symbol_references, i.symbols, i.files, NAME)


@query(f"SELECT '{NAME}' AS symbol, count(*) AS n_references FROM symbol_references r JOIN symbols s ON s.id = r.symbol_id WHERE s.name = '{NAME}'")
def count_references(i):
    return symbols.count_references(i.symbol_references, i.symbols, NAME)


@query(f"SELECT s.name, s.kind, path, content, d.line_start, d.line_end FROM docstrings d JOIN symbols s ON s.id = d.symbol_id JOIN files f ON f.id = s.file_id WHERE s.name = '{NAME}'")
def docstring(i):
    return symbols.get_docstring(i.docstrings, i.symbols, i.files, NAME)


@query(f"""SELECT param_name, annotation, (SELECT max_by(annotation, symbol_id) FROM type_hints t JOIN symbols s ON s.id = t.symbol_id WHERE s.name = '{NAME}' AND is_return) AS return_type FROM (
  SELECT param_name, max_by(annotation, symbol_id) AS annotation FROM type_hints t JOIN symbols s ON s.id = t.symbol_id WHERE s.name = '{NAME}' AND NOT is_return GROUP BY param_name)""")
def type_info(i):
    return symbols.get_type_info(i.type_hints, i.symbols, i.files, NAME).select(F.explode("params").alias("param_name", "annotation"), "return_type")


@query(f"SELECT 'function' AS kind, name FROM symbols s JOIN files f ON f.id = s.file_id WHERE path = '{PATH}' AND kind = 'function' UNION ALL SELECT 'method', name FROM symbols s JOIN files f ON f.id = s.file_id WHERE path = '{PATH}' AND kind = 'method' UNION ALL SELECT 'class', name FROM symbols s JOIN files f ON f.id = s.file_id WHERE path = '{PATH}' AND kind = 'class'")
def defined_symbols(i):
    row = symbols.defined_symbols(i.symbols, i.files, PATH)
    one = lambda kind, c: row.select(F.lit(kind).alias("kind"), F.explode(c).alias("name"))
    return one("function", "functions").unionByName(one("method", "methods")).unionByName(one("class", "classes"))


# --- text ----------------------------------------------------------------------------------------------------------------
def _grep(where: str, limit: int, col: str, lang: str | None = None) -> str:
    only = f"AND f.lang = '{lang}'" if lang else ""
    return f"""SELECT path AS file, line_no AS line, {col} AS col, rtrim(text) AS text FROM (SELECT l.*, path, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn
      FROM lines l JOIN files f ON f.id = l.file_id WHERE {where} {only}) WHERE rn <= {min(limit, 20)} ORDER BY path, line_no LIMIT {limit}"""


@query(_grep("contains(text, 'tion the')", 100, "(instr(text, 'tion the') - 1)::INT"))
def grep_literal(i):
    return textsearch.search_code(i.lines, i.files, "tion the", limit=100)


@query(_grep("regexp_matches(text, '[a-z]+ing [a-z]+ed')", 100, "length(regexp_extract(text, '^(.*?)[a-z]+ing [a-z]+ed', 1))::INT"))
def grep_regex(i):
    return textsearch.search_code(i.lines, i.files, "[a-z]+ing [a-z]+ed", limit=100, regex=True)


@query(_grep("contains(text, ' a')", 1000, "(instr(text, ' a') - 1)::INT"))
def grep_file_cap(i):
    return textsearch.search_code(i.lines, i.files, " a", limit=1000)


@query("""SELECT path AS file, line_no AS line, coalesce(before, '') AS before, coalesce(after, '') AS after FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn FROM (
  SELECT l.file_id, path, line_no, text, string_agg(text, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before,
  string_agg(text, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM lines l JOIN files f ON f.id = l.file_id) WHERE contains(text, 'ation')) WHERE rn <= 20 ORDER BY path, line_no LIMIT 60""")
def grep_context(i):
    return textsearch.search_code(i.lines, i.files, "ation", limit=60, context=2).select("file", "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query(f"SELECT line_no AS line, text FROM lines l JOIN files f ON f.id = l.file_id WHERE path = '{PATH}' AND regexp_matches(text, 'th[a-z]+')")
def grep_file(i):
    return textsearch.grep_file(i.lines, i.files, PATH, "th[a-z]+").drop("col")


@query("SELECT path FROM files WHERE regexp_matches(split_part(path, '/', 3), 'doc_1[0-9]\\.')")
def find_file(i):
    return textsearch.find_file(i.files, r"doc_1[0-9]\.")


@query(f"SELECT line_no AS line, text FROM lines l JOIN files f ON f.id = l.file_id WHERE path = '{PATH}' AND line_no BETWEEN 2 AND 5")
def read_range(i):
    return textsearch.read_lines(i.lines, i.files, PATH, 2, 5)


@query("SELECT file_id, count(*) - CASE WHEN max_by(text, line_no) = '' THEN 1 ELSE 0 END AS n_lines FROM lines GROUP BY file_id")
def count_lines(i):
    return textsearch.count_lines(i.lines)


# --- calls ---------------------------------------------------------------------------------------------------------------
EDGE = "caller_name, caller_file, caller_line, callee_name, callee_file, callee_id, caller_id, line, pos"


@query(f"SELECT {EDGE} FROM edge_view")
def call_edges(i):
    return graph.edge_view(i)


@query(f"SELECT {EDGE} FROM edge_view WHERE callee_name = '{CALLEE}'")
def callers(i):
    return graph.callers(graph.edge_view(i), CALLEE)


@query(f"SELECT {EDGE} FROM edge_view WHERE caller_name = '{CALLER}' AND lower(caller_file) LIKE 'src1/%'")
def callees(i):
    return graph.callees(graph.edge_view(i), CALLER, directory="src1")


@query(f"SELECT {EDGE} FROM edge_view WHERE (caller_name IN ('{CALLER}', 'and') OR callee_name IN ('{CALLER}', 'and')) AND (lower(caller_file) LIKE 'src4/%' OR lower(caller_file) LIKE '%/src4/%')")
def query_edges(i):
    return graph.query_edges(graph.edge_view(i), symbols=[CALLER, "and"], package="src4")


@query(f"SELECT caller_name, caller_file FROM edge_view WHERE callee_name = '{CALLEE}' GROUP BY ALL")
def impact_callers(i):
    return graph.impact(i, CALLEE).select(F.explode("callers").alias("c")).select("c.caller_name", "c.caller_file")


@query(f"SELECT DISTINCT path FROM symbol_references r JOIN symbols s ON s.id = r.symbol_id JOIN files f ON f.id = r.file_id WHERE s.name = '{CALLEE}'")
def impact_files(i):
    return graph.impact(i, CALLEE).select(F.explode("affected_files").alias("path"))


@query("SELECT count(*) AS n_edges, count(DISTINCT caller_name) AS n_callers, count(DISTINCT callee_name) AS n_callees FROM edge_view")
def call_graph_totals(i):
    return graph.call_graph_summary(graph.edge_view(i))["totals"]


@query("SELECT callee_file AS name, count(*) AS n FROM edge_view WHERE callee_file IS NOT NULL GROUP BY callee_file ORDER BY n DESC, name LIMIT 10")
def call_graph_depended(i):
    return graph.call_graph_summary(graph.edge_view(i))["depended"]


@query("SELECT callee_name, string_agg(caller_name, ',' ORDER BY caller_name) AS names FROM (SELECT DISTINCT callee_name, caller_name FROM edge_view) GROUP BY callee_name")
def lookup_callers(i):
    return graph.lookup_maps(graph.edge_view(i))[0].select("callee_name", F.array_join(F.array_sort("names"), ",").alias("names"))


LIVE = "live AS (SELECT DISTINCT callee_id AS c, caller_id AS up FROM call_edges WHERE callee_id IN (SELECT id FROM symbols) AND caller_id IN (SELECT id FROM symbols))"
WALK = f"{LIVE}, walk AS (SELECT c AS symbol_id, up AS caller_id, 1 AS depth FROM live UNION ALL SELECT w.symbol_id, live.up, w.depth + 1 FROM walk w JOIN live ON w.caller_id = live.c WHERE w.depth < 3)"


@query(f"WITH {WALK} SELECT symbol_id, caller_id, min(depth) AS depth FROM walk GROUP BY symbol_id, caller_id", recursive=True)
def closure_3(i):
    return graph.closure(graph.live_edges(i), 3)


@query(f"""WITH {WALK}, near AS (SELECT symbol_id, caller_id, min(depth) AS depth FROM walk GROUP BY symbol_id, caller_id)
SELECT n.depth, count(*) AS n_callers FROM near n WHERE symbol_id = (SELECT min(id) FROM symbols WHERE name = '{ROOT}') GROUP BY n.depth""", recursive=True)
def blast_radius(i):
    return graph.blast_radius(graph.closure(graph.live_edges(i), 3), i.symbols, i.files, ROOT).select("depth", "n_callers")


#: The same walk to its end: a pair that has been reached isn't reached again.
WHOLE_WALK = f"""{LIVE}, walk(symbol_id, caller_id, depth) USING KEY (symbol_id, caller_id) AS (SELECT c, up, 1 FROM live UNION SELECT DISTINCT w.symbol_id, live.up, w.depth + 1 FROM walk w JOIN live ON w.caller_id = live.c
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.symbol_id = w.symbol_id AND r.caller_id = live.up))"""


@query(f"WITH {WHOLE_WALK} SELECT symbol_id, caller_id, depth FROM walk", recursive=True)
def closure(i):
    return graph.closure(graph.live_edges(i))


@query(f"WITH {WHOLE_WALK} SELECT depth, count(*) AS n_callers FROM walk WHERE symbol_id = (SELECT min(id) FROM symbols WHERE name = '{ROOT}') GROUP BY depth", recursive=True)
def blast_radius_full(i):
    return graph.blast_radius(graph.closure(graph.live_edges(i)), i.symbols, i.files, ROOT).select("depth", "n_callers")


NAMED = "e AS (SELECT DISTINCT caller_name, callee_name, caller_file, caller_line FROM edge_view)"


@query(f"""WITH {NAMED}, reach AS (SELECT '{CALLEE}' AS name, 0 AS depth UNION ALL SELECT e.caller_name, r.depth + 1 FROM reach r JOIN e ON e.callee_name = r.name WHERE r.depth < 2),
seen AS (SELECT name, min(depth) AS depth FROM reach GROUP BY name)
SELECT DISTINCT e.caller_name AS caller, e.callee_name AS callee, e.caller_file AS file, e.caller_line AS line, s.depth + 1 AS depth FROM seen s JOIN e ON e.callee_name = s.name LEFT JOIN seen t ON t.name = e.caller_name
WHERE s.depth < 2 AND coalesce(t.depth, 99) = s.depth + 1""", recursive=True)
def trace_2(i):
    return graph.trace(graph.edge_view(i), CALLEE, 2).drop("chain")


@query(f"""WITH {NAMED}, seen(name, depth) USING KEY (name) AS (SELECT '{CALLEE}', 0 UNION SELECT DISTINCT e.caller_name, s.depth + 1 FROM seen s JOIN e ON e.callee_name = s.name WHERE s.depth < 5 AND NOT EXISTS (SELECT 1 FROM recurring.seen r WHERE r.name = e.caller_name))
SELECT DISTINCT e.caller_name AS caller, e.callee_name AS callee, e.caller_file AS file, e.caller_line AS line, t.depth FROM seen s JOIN e ON e.callee_name = s.name JOIN seen t ON t.name = e.caller_name AND t.depth = s.depth + 1""", recursive=True)
def trace(i):
    return graph.trace(graph.edge_view(i), CALLEE).drop("chain")


@query(f"""WITH firsts AS (SELECT name, min(id) AS id FROM symbols GROUP BY name), go AS (SELECT DISTINCT caller_id AS a, f.id AS b FROM call_edges e JOIN firsts f ON f.name = e.callee_name),
flow AS (SELECT min(id) AS id, 0 AS depth FROM symbols WHERE name ILIKE '%{START}%' UNION ALL SELECT go.b, flow.depth + 1 FROM flow JOIN go ON go.a = flow.id WHERE flow.depth < 4)
SELECT f.id, s.name, s.kind, path, s.line_start, min(f.depth) AS depth FROM flow f JOIN symbols s ON s.id = f.id JOIN files ON files.id = s.file_id GROUP BY f.id, s.name, s.kind, path, s.line_start""", recursive=True)
def endpoint_flow_4(i):
    return graph.endpoint_flow(i, START, 4).drop("calls")


@query(f"""WITH firsts AS (SELECT name, min(id) AS id FROM symbols GROUP BY name), go AS (SELECT DISTINCT caller_id AS a, f.id AS b FROM call_edges e JOIN firsts f ON f.name = e.callee_name),
flow(id, depth) USING KEY (id) AS (SELECT min(id), 0 FROM symbols WHERE name ILIKE '%{START}%' UNION SELECT DISTINCT go.b, flow.depth + 1 FROM flow JOIN go ON go.a = flow.id WHERE flow.depth < 8 AND NOT EXISTS (SELECT 1 FROM recurring.flow r WHERE r.id = go.b))
SELECT f.id, s.name, s.kind, path, s.line_start, f.depth FROM flow f JOIN symbols s ON s.id = f.id JOIN files ON files.id = s.file_id""", recursive=True)
def endpoint_flow(i):
    return graph.endpoint_flow(i, START).drop("calls")


# --- imports -------------------------------------------------------------------------------------------------------------
@query(f"SELECT module, level, is_star FROM imports i JOIN files f ON f.id = i.file_id WHERE path = '{PATH}'")
def file_imports(i):
    return deps.file_imports(i.imports, i.files, PATH)


@query("SELECT path, module, level, is_star FROM imports i JOIN files f ON f.id = i.file_id WHERE module = 'src3' OR starts_with(module, 'src3.')")
def importers(i):
    return deps.importers(i.imports, i.files, "src3")


@query(f"SELECT DISTINCT g.path, b.module FROM imports a JOIN files f ON f.id = a.file_id JOIN imports b ON b.module = a.module JOIN files g ON g.id = b.file_id WHERE f.path = '{PATH}' AND g.path <> '{PATH}'")
def co_imports(i):
    return deps.co_importers(i.imports, i.files, PATH)


# --- audit ---------------------------------------------------------------------------------------------------------------
@query("""SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM symbols) AS n_symbols, count(*) AS n_edges, count(*) FILTER (callee_id IS NULL) AS n_unresolved,
  count(*) FILTER (callee_id IS NULL) / count(*) AS unresolved_ratio, 'degraded' AS status FROM call_edges WHERE caller_id IN (SELECT id FROM symbols)""")
def health(i):
    return audit.health(i).select("n_files", "n_symbols", "n_edges", "n_unresolved", "unresolved_ratio", "status")


@query("""SELECT relation, n FROM (SELECT 'symbols' AS relation, count(*) AS n FROM symbols WHERE file_id NOT IN (SELECT id FROM files) UNION ALL SELECT 'call_edges', count(*) FROM call_edges WHERE caller_id NOT IN (SELECT id FROM symbols)
  UNION ALL SELECT 'symbol_references', count(*) FROM symbol_references WHERE symbol_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'docstrings', count(*) FROM docstrings WHERE symbol_id NOT IN (SELECT id FROM symbols)
  UNION ALL SELECT 'imports', count(*) FROM imports WHERE file_id NOT IN (SELECT id FROM files) UNION ALL SELECT 'embeddings', count(*) FROM vectors WHERE symbol_id NOT IN (SELECT id FROM symbols))""")
def orphans(i):
    return audit.orphan_counts(i)


@query("""SELECT s.id, s.name, s.kind, path, s.line_start, s.line_end FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN (SELECT DISTINCT callee_id FROM call_edges) c ON c.callee_id = s.id LEFT JOIN (SELECT DISTINCT symbol_id FROM symbol_references) r ON r.symbol_id = s.id
  WHERE c.callee_id IS NULL AND r.symbol_id IS NULL AND s.kind IN ('function', 'method')""")
def unused_symbols(i):
    return audit.find_unused(i, "symbols", max_unresolved=1.0)[1]


# --- vectors -------------------------------------------------------------------------------------------------------------
COS = "round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT v.symbol_id, {COS} AS distance FROM vectors v, (SELECT embedding FROM vectors WHERE symbol_id = 70000001) q ORDER BY 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.symbol_id LIMIT 10")
def semantic_topk(i):
    one = i.embeddings.filter("symbol_id = 70000001").select(F.col("embedding").alias("q"))
    return vector.nearest(i.embeddings, one, 10).withColumn("distance", F.round("distance", 6))


@query(f"""SELECT v.symbol_id, s.name, s.kind, path, s.line_start, s.line_end, d AS distance FROM (SELECT v.symbol_id, {COS} AS d FROM vectors v, (SELECT symbol_id, embedding FROM vectors WHERE symbol_id = (SELECT min(id) FROM symbols WHERE name = 'doc_9')) q WHERE v.symbol_id <> q.symbol_id
  ORDER BY 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.symbol_id LIMIT 5) v JOIN symbols s ON s.id = v.symbol_id JOIN files f ON f.id = s.file_id""")
def similar_topk(i):
    return vector.similar(i.embeddings, i.symbols, i.files, "doc_9").withColumn("distance", F.round("distance", 6))


# --- history -------------------------------------------------------------------------------------------------------------
@query("SELECT symbol_id, file_path, commit_hash, commit_date, commit_msg, change_type, lines_added, lines_removed FROM git_history")
def hunk_overlap(i):
    return i.git_history.drop("id")


@query("""SELECT s.name, h.symbol_id, substr(commit_hash, 1, 8) AS commit, commit_date, commit_msg, change_type, lines_added, lines_removed, file_path FROM git_history h JOIN symbols s ON s.id = h.symbol_id WHERE s.name = 'doc_9'
  ORDER BY commit_date DESC, commit_hash, h.symbol_id LIMIT 20""")
def function_history(i):
    return history.function_history(i.git_history, i.symbols, "doc_9")


# --- text functions, logs, SQL, streams ------------------------------------------------------------------------------------
@query("SELECT name, levenshtein(name, 'thonre') AS distance FROM (SELECT DISTINCT name FROM symbols) ORDER BY distance, name LIMIT 20")
def levenshtein_rank(i):
    return textops.levenshtein_rank(i.symbols.select("name").distinct(), "name", "thonre", 20)


@query("SELECT doc_id, CASE WHEN instr(text, 'the ') > 0 THEN substr(text, 1, instr(text, 'the ') - 1) || 'THE ' || substr(text, instr(text, 'the ') + 4) END AS new_content FROM documents")
def replace_first(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"), F.lit("the ").alias("old_code"), F.lit("THE ").alias("new_code"))
    return textops.legacy_preview(d).select("doc_id", "new_content")


@query("""SELECT id, line, code FROM (SELECT event_id AS id, (event_id % 50 + 1)::INT AS line, CASE WHEN event_type = 'click' THEN 'E501' ELSE 'W291' END AS code FROM events)""")
def log_parse(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = e.select(F.col("event_id").alias("id"), F.format_string("src/m%d.py:%d:%d: %s some text", F.col("user_id"), F.col("event_id") % 50 + 1, F.col("event_id") % 9, F.when(F.col("event_type") == "click", "E501").otherwise("W291")).alias("raw"))
    return logs.parse_ruff(raw).select("id", "line", "code")


def _previews(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = F.trim(F.get(F.split("text", "\n"), F.lit(0)))
    rows = d.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.col("text").alias("content"), F.concat(F.lit("  "), first).alias("old_code"), F.lit("changed line").alias("new_code"))
    return textops.preview_edits(rows)


@query()
def fuzzy_replace(spark, sf_dir):
    return _previews(spark, sf_dir).select("doc_id", "preview.new_content", "preview.error")


@query()
def unified_diff(spark, sf_dir):
    return _previews(spark, sf_dir).select("doc_id", "preview.diff", "preview.lines_changed")


@query("SELECT lang, count(*) AS n, count(DISTINCT path) AS paths FROM files GROUP BY lang HAVING count(*) > 1")
def sql_door(i):
    i.create_views("tw_")
    return sqldoor.run_query(i.files.sparkSession, "SELECT lang, count(*) AS n, count(DISTINCT path) AS paths FROM tw_files GROUP BY lang HAVING count(*) > ?", [1])


@query("SELECT user_id, max_by(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def latest_version(spark, sf_dir):
    return changes.latest(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type"), "user_id").drop("ts")


@query("SELECT user_id, max_by(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*").select("user_id", "ts", "event_id", "event_type")
    checkpoint = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    state.keep_newest(source, "user_id", ("ts", "event_id"), checkpoint).awaitTermination()
    return state.held(spark, checkpoint).drop("ts")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def log_tail(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.struct("ts", "event_id"))
    return changes.tail(e, "at").select("event_id", "event_type")


@query("SELECT path FROM files WHERE lower(path) LIKE 'src7/%' AND (lower(path) LIKE 'src7/en/%' OR lower(path) LIKE '%/src7/en/%') AND path ILIKE '%doc_1%'")
def path_filters(i):
    return i.files.filter(symbols.path_filter(F.col("path"), directory="src7/", package="src7.en", query="doc_1")).select("path")


@query("SELECT DISTINCT 'directory' AS kind, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS value FROM files WHERE contains(lower(path), 'src1/') UNION SELECT DISTINCT 'directory', split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM files WHERE path LIKE 'src1/%'")
def suggestions(i):
    return scan.suggest(i.files, "src1/")


#: Queries that bench.py times.
HEADLINE = ("symbol_search_ranked", "grep_regex", "grep_context", "resolve_calls", "callers", "closure", "trace", "overview_edges", "importers", "unused_symbols", "health", "semantic_topk", "hunk_overlap", "references_last", "levenshtein_rank", "stream_latest")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["symbol_search_ranked"](spark, sf_dir)
