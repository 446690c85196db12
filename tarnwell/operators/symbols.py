"""Symbols: ranked search, index and overview pages, bodies and signatures, usages, docs and types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.operators.paths import like, path_filter, required

LETTERS = {"f": "function", "c": "class", "m": "method", "i": "interface"}
BODY_LINES = 100


def _paths(files: DataFrame) -> DataFrame:
    return files.select(F.col("id").alias("file_id"), "path")


def compact(name: str = "name", kind: str = "kind", path: str = "path") -> Column:
    """name:k:file:start-end."""
    return F.format_string("%s:%s:%s:%d-%d", F.col(name), F.substring(kind, 1, 1), F.col(path), F.col("line_start"), F.col("line_end"))


def parse_compact(entry: Column) -> Column:
    pattern = r"^(.*?):(.):(.*):(\d+)-(\d+)$"
    part = lambda k: F.regexp_extract(entry, pattern, k)
    kind = F.coalesce(*[F.when(part(2) == k, F.lit(v)) for k, v in LETTERS.items()])
    return F.struct(part(1).alias("name"), kind.alias("kind"), part(3).alias("file"), part(4).cast("int").alias("line_start"), part(5).cast("int").alias("line_end"))


def rank(column: Column, name: str, escape: bool = False) -> Column:
    """0 for the name itself, 1 where it begins so, else 2."""
    return F.when(column == name, 0).when(like(column, name, before="", escape=escape), 1).otherwise(2)


def search_symbol(symbols: DataFrame, files: DataFrame, name: str, *, kind: str | None = None, limit: int = 50, file_filter: Sequence[str] | None = None, directory: str | None = None, package: str | None = None, escape: bool = False) -> DataFrame:
    """Symbols whose name holds `name`, exact ones first, then those that begin so; at most `limit`."""
    required(name, "name", 2)
    found = symbols.filter(like(F.col("name"), name, escape=escape))
    if kind:
        found = found.filter(F.col("kind") == kind)
    found = found.join(_paths(files).filter(path_filter(F.col("path"), file_filter, directory, package)), "file_id").withColumn("rank", rank(F.col("name"), name, escape))
    found = found.orderBy("rank", "name", "path", "line_start", "id").limit(limit)
    return found.select("id", "file_id", "name", "kind", "path", "line_start", "line_end", "rank", compact().alias("entry"))


def file_page(symbols: DataFrame, files: DataFrame, *, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """The page of files that have symbols and pass the filters, by path, with how many there are in all."""
    own = files.filter(path_filter(F.col("path"), **filters)).join(symbols.select(F.col("file_id").alias("id")), "id", "left_semi")
    page = own.orderBy("path").offset(offset).limit(limit).select(F.col("id").alias("file_id"), "path", "lang")
    total = own.agg(F.count("*").alias("total_files"))
    return page.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.lit(offset + limit) < F.col("total_files")).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))


def index_page(symbols: DataFrame, files: DataFrame, **page) -> DataFrame:
    """A page of files with their symbols in order of lines."""
    rows = symbols.join(file_page(symbols, files, **page), "file_id")
    entry = F.struct("line_start", "name", "kind", "line_end")
    return rows.groupBy("path", "lang", "total_files", "has_more", "next_offset").agg(F.count("*").alias("n_symbols"), F.sort_array(F.collect_list(entry)).alias("symbols")).orderBy("path")


def repo_overview(symbols: DataFrame, files: DataFrame, edge_view: DataFrame, *, file_filter: Sequence[str] | None = None, directory: str | None = None, package: str | None = None, query: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(files with their symbols as text, edges that touch them as `caller@line -> callees`); a filter must be given."""
    if not (file_filter or directory or package or query):
        raise ValueError("an overview needs a filter")
    page = file_page(symbols, files, limit=limit, offset=offset, paths=file_filter, directory=directory, package=package, query=query)
    text = F.concat(F.format_string("%s:%s:%d-%d", F.col("name"), F.substring("kind", 1, 1), F.col("line_start"), F.col("line_end")))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("line_start", "name", text.alias("t")))), lambda x: x["t"])
    listed = symbols.join(page, "file_id").groupBy("path", "total_files", "has_more").agg(F.array_join(entries, " ").alias("symbols")).orderBy("path")
    here = page.select("path")
    touching = edge_view.join(here.select(F.col("path").alias("caller_file")), "caller_file", "left_semi").unionByName(edge_view.join(here.select(F.col("path").alias("callee_file")), "callee_file", "left_semi").join(here.select(F.col("path").alias("caller_file")), "caller_file", "left_anti"))
    return listed, group_edges(touching)


def group_edges(edge_view: DataFrame) -> DataFrame:
    """Callees by caller and line, each once, in order of first call."""
    first = edge_view.groupBy("caller_name", "caller_line", "callee_name").agg(F.min(F.struct("caller_file", "line", "pos")).alias("at"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("at", "callee_name"))), lambda x: x["callee_name"])
    out = first.groupBy("caller_name", "caller_line").agg(F.array_join(names, ", ").alias("callees"))
    return out.select(F.concat("caller_name", F.lit("@"), F.col("caller_line").cast("string")).alias("caller"), "callees").orderBy("caller")


def repo_summary(symbols: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols and lines of every file, also of those without."""
    s = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n_symbols"))
    n = lines.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n_lines"))
    return files.join(s, "id", "left").join(n, "id", "left").select("path", "lang", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def extension_language(path: Column, languages: dict[str, str]) -> Column:
    """A file's language by its extension: an unmapped extension stands for itself, none is unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "", "unknown").otherwise(F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in languages.items()], ext))


def language_histogram(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    return files.groupBy(extension_language(F.col("path"), languages).alias("language")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def directory_stats(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Files and symbols below each top folder; files without a folder are in `.`."""
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("."))
    n = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("k"))
    return files.join(n, "id", "left").groupBy(top.alias("directory")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_symbols")).orderBy(F.desc("n_symbols"), "directory")


def top_files(symbols: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    return symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols")).join(_paths(files), "file_id").orderBy(F.desc("n_symbols"), "path").limit(limit).select("path", "n_symbols")


def kind_histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def file_overview(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return symbols.join(_paths(files).filter(F.col("path") == path), "file_id").orderBy("line_start", "id").select("name", "kind", "line_start", "line_end", F.count("*").over(W.partitionBy("file_id")).alias("total"))


def get_definition(symbols: DataFrame, files: DataFrame, lines: DataFrame, path: str, name: str, kinds: Sequence[str] = ("function", "method")) -> DataFrame:
    """The first symbol of a name and kind in a file, with its source."""
    one = symbols.filter((F.col("name") == name) & F.col("kind").isin(*kinds)).join(_paths(files).filter(F.col("path") == path), "file_id").orderBy("line_start", "id").limit(1)
    return with_source(one, lines)


def with_source(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """symbols with source, the text of their lines."""
    li = lines.select(F.col("file_id").alias("l_file"), "line_no", "text")
    rows = symbols.join(li, (F.col("file_id") == F.col("l_file")) & F.col("line_no").between(F.col("line_start"), F.col("line_end")))
    keys = [c for c in symbols.columns]
    text = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return rows.groupBy(*keys).agg(F.array_join(text, "\n").alias("source"))


def function_body(lines: DataFrame, files: DataFrame, path: str, line_start: int, line_end: int, window_start: int | None = None, window_end: int | None = None, max_lines: int = BODY_LINES) -> DataFrame:
    """One row: a window of a body, cut to the body and to max_lines, and where the next begins."""
    from tarnwell.operators.textsearch import read_lines

    if line_start < 1 or line_end < line_start:
        raise ValueError("line ranges are 1-based and inclusive")
    start = max(line_start, window_start or line_start)
    end = min(line_end, window_end or line_end, start + max_lines - 1)
    rows = read_lines(lines, files, path, start, max(start, end))
    text = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    more = end < line_end
    return rows.agg(F.array_join(text, "\n").alias("body")).select("body", F.lit(start).alias("window_start"), F.lit(end).alias("window_end"), F.lit(more).alias("has_more"), F.lit(end + 1 if more else None).cast("int").alias("next_window_start"))


def find_usages(references: DataFrame, symbols: DataFrame, files: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Where symbols of a name are referred to: files are those of the references."""
    required(name, "symbol")
    of = symbols.filter(F.col("name") == name).select(F.col("id").alias("symbol_id"), "name", "kind")
    return references.join(of, "symbol_id").join(_paths(files), "file_id").orderBy("path", "line", "symbol_id").limit(limit).select("name", "kind", "path", "line")


def count_references(references: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    required(name, "symbol")
    of = symbols.filter(F.col("name") == name).select(F.col("id").alias("symbol_id"))
    return references.join(of, "symbol_id", "left_semi").agg(F.count("*").alias("n_references")).select(F.lit(name).alias("symbol"), "n_references")


def get_docstring(docstrings: DataFrame, symbols: DataFrame, files: DataFrame, name: str, path: str | None = None) -> DataFrame:
    required(name, "symbol")
    of = symbols.filter(F.col("name") == name).select(F.col("id").alias("symbol_id"), "name", "kind", "file_id").join(_paths(files), "file_id")
    if path:
        of = of.filter(F.col("path") == path)
    return docstrings.join(of, "symbol_id").orderBy("path", "line_start").select("name", "kind", "path", "content", "line_start", "line_end")


def get_type_info(type_hints: DataFrame, symbols: DataFrame, files: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """One row: parameters with their annotation (the last by name and symbol) and the return annotation."""
    of = symbols.filter(F.col("name") == name).select(F.col("id").alias("symbol_id"), "file_id")
    if path:
        of = of.join(_paths(files).filter(F.col("path") == path), "file_id")
    rows = type_hints.join(of, "symbol_id")
    params = rows.filter("not is_return").groupBy("param_name").agg(F.max_by("annotation", "symbol_id").alias("annotation"))
    params = params.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("param_name", "annotation")))).alias("params"))
    back = rows.filter("is_return").agg(F.max_by("annotation", "symbol_id").alias("return_type"))
    return params.join(back, F.lit(True))


def defined_symbols(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """One row: names by kind in order of lines. Constants aren't symbols, so that list is empty."""
    own = symbols.join(_paths(files).filter(F.col("path") == path), "file_id")
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("line_start", "name")))), lambda x: x["name"])
    return own.agg(of("function").alias("functions"), of("class").alias("classes"), of("method").alias("methods"), F.array().cast("array<string>").alias("constants"))


def extract_by_name(symbols: DataFrame, files: DataFrame, lines: DataFrame, name: str, kind: str | None = None, extract: str = "both") -> DataFrame:
    """Up to ten matches with their signature, their body, or both."""
    from tarnwell.functions.textops import signature

    if extract not in ("signature", "body", "both"):
        raise ValueError("extract is signature, body or both")
    found = with_source(search_symbol(symbols, files, name, kind=kind, limit=10), lines)
    out = found.withColumn("signature", signature(F.split("source", "\n"))).orderBy("rank", "name", "path", "line_start")
    return out.drop("source") if extract == "signature" else out.drop("signature") if extract == "body" else out


def edit_context(index, name: str, path: str | None = None, directory: str | None = None, package: str | None = None) -> DataFrame:
    """Candidates of a name, exact ones alone where there are any. With one, the row has its source, three lines before,
    signature, callers and callees within its file, and imports; with more, `candidates` tells to choose."""
    from tarnwell.functions.textops import signature
    from tarnwell.operators.graph import edge_view

    found = search_symbol(index.symbols, index.files, name, file_filter=[path] if path else None, directory=directory, package=package)
    best = found.filter(F.col("rank") == 0) if not found.filter("rank = 0").isEmpty() else found
    n = best.agg(F.count("*").alias("candidates"))
    best = with_source(best, index.lines).join(n, F.lit(True)).withColumn("signature", signature(F.split("source", "\n")))
    li = index.lines.select(F.col("file_id").alias("l_file"), "line_no", "text")
    ahead = best.select("id", "file_id", "line_start").join(li, (F.col("file_id") == F.col("l_file")) & F.col("line_no").between(F.col("line_start") - 3, F.col("line_start") - 1))
    ahead = ahead.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("preamble"))
    edges = edge_view(index)
    callers = edges.filter(F.col("caller_file") == F.col("callee_file")).groupBy(F.col("callee_id").alias("id")).agg(F.array_sort(F.collect_set("caller_name")).alias("callers"))
    callees = edges.filter(F.col("caller_file") == F.col("callee_file")).groupBy(F.col("caller_id").alias("id")).agg(F.array_sort(F.collect_set("callee_name")).alias("callees"))
    imports = index.imports.groupBy("file_id").agg(F.array_sort(F.collect_set("module")).alias("imports"))
    return best.join(ahead, "id", "left").join(callers, "id", "left").join(callees, "id", "left").join(imports, "file_id", "left").orderBy("rank", "name", "path", "line_start")
