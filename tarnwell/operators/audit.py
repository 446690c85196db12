"""Integrity and unused code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of unresolved calls above which an index isn't fit for the unused audit.
MAX_UNRESOLVED = 0.30
#: Names that need no definition, by language.
BUILTINS = {
    "python": ("abs", "all", "any", "bool", "bytes", "callable", "dict", "dir", "enumerate", "eval", "exec", "filter", "float", "format", "getattr", "hasattr", "hash", "id", "input", "int", "isinstance", "issubclass", "iter", "len", "list", "map", "max", "min", "next", "open", "ord", "pow", "print", "range", "repr", "reversed", "round", "set", "setattr", "sorted", "str", "sum", "super", "tuple", "type", "vars", "zip"),
    "javascript": ("alert", "clearInterval", "clearTimeout", "decodeURIComponent", "encodeURIComponent", "fetch", "isNaN", "parseFloat", "parseInt", "require", "setInterval", "setTimeout"),
    "go": ("append", "cap", "close", "copy", "delete", "len", "make", "new", "panic", "print", "println", "recover"),
    "rust": ("drop", "print", "println", "vec", "format", "panic", "assert"),
}


def orphan_counts(index) -> DataFrame:
    """relation, n: rows whose parent isn't there."""
    ids, files = index.symbols.select("id"), index.files.select("id")

    def lost(name: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        return child.select(F.col(key).alias("id")).filter("id is not null").join(parent, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")

    out = lost("symbols", index.symbols, "file_id", files)
    for name, child, key, parent in (
        ("call_edges", index.call_edges, "caller_id", ids), ("symbol_references", index.symbol_references, "symbol_id", ids), ("docstrings", index.docstrings, "symbol_id", ids),
        ("imports", index.imports, "file_id", files), ("embeddings", index.embeddings, "symbol_id", ids),
    ):
        out = out.unionByName(lost(name, child, key, parent))
    return out


def health(index, max_unresolved: float = MAX_UNRESOLVED) -> DataFrame:
    """One row: counts, the share of unresolved calls, orphans in all and by relation, status and advice."""
    ids = index.symbols.select(F.col("id").alias("caller_id"))
    live = index.call_edges.join(ids, "caller_id", "left_semi").agg(F.count("*").alias("n_edges"), F.count_if(F.col("callee_id").isNull()).alias("n_unresolved"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    orphans = orphan_counts(index).agg(F.sum("n").alias("n_orphans"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "n")))).alias("orphans"))
    row = count(index.files, "n_files")
    for other in (count(index.symbols, "n_symbols"), count(index.symbol_references, "n_references"), count(index.imports, "n_imports"), live, orphans):
        row = row.crossJoin(other)  # of single rows
    row = row.withColumn("unresolved_ratio", F.when(F.col("n_edges") > 0, F.col("n_unresolved") / F.col("n_edges")).otherwise(F.lit(0.0)))
    bad = F.col("unresolved_ratio") > max_unresolved
    advice = F.filter(F.array(F.when(F.col("n_files") == 0, "index is empty: build it"), F.when(bad, "many calls are unresolved: rebuild the index"), F.when(F.col("n_orphans") > 0, "rows without parents: clear and rebuild")), lambda x: x.isNotNull())
    status = F.when(F.col("n_files") == 0, "empty").when(bad | (F.col("n_orphans") > 0), "degraded").otherwise("healthy")
    return row.withColumn("recommendations", advice).withColumn("status", status)


def unused_symbols(index) -> DataFrame:
    """Functions and methods that no resolved call and no reference reaches and that no decorator registers."""
    called = index.call_edges.filter("callee_id is not null").select(F.col("callee_id").alias("id"))
    referred = index.symbol_references.select(F.col("symbol_id").alias("id"))
    left = index.symbols.filter(F.col("kind").isin("function", "method")).join(called, "id", "left_anti").join(referred, "id", "left_anti")
    left = left.join(index.decorated, ["file_id", "name"], "left_anti").join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return left.select("id", "name", "kind", "path", "line_start", "line_end").orderBy("path", "name", "line_start")


def unused_imports(index) -> DataFrame:
    """Modules none of whose local names is used outside imports; star imports are exempt."""
    names = index.imported_names.filter("not is_star")
    used = index.name_uses.select("file_id", "name").distinct().withColumn("used", F.lit(1))
    by = names.join(used, ["file_id", "name"], "left").groupBy("file_id", "module", "level", "is_star").agg(F.count("used").alias("n_used"))
    return by.filter("n_used = 0").join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("module", "path", "level", "is_star").orderBy("path", "module")


def unresolved_calls(index) -> DataFrame:
    """Names called as bare functions that are neither resolved, nor built in, nor imported, by file."""
    callers = index.symbols.select(F.col("id").alias("caller_id"), "file_id")
    names = index.call_edges.filter("callee_id is null").join(callers, "caller_id").select("file_id", F.col("callee_name").alias("name")).distinct()
    names = names.join(index.bare_calls, ["file_id", "name"], "left_semi").join(index.imported_names.select("file_id", "name"), ["file_id", "name"], "left_anti")
    names = names.join(index.files.select(F.col("id").alias("file_id"), "path", "lang"), "file_id")
    for lang, builtins in BUILTINS.items():
        same = ("javascript", "typescript") if lang == "javascript" else (lang,)
        names = names.filter(~(F.col("lang").isin(*same) & F.col("name").isin(*builtins)))
    return names.select("path", "name").orderBy("path", "name")


def find_unused(index, scope: str, max_unresolved: float = MAX_UNRESOLVED) -> tuple[dict, DataFrame | None]:
    """(gate, rows): the audit of imports, symbols or calls, blocked while too many calls are unresolved."""
    audits = {"imports": unused_imports, "symbols": unused_symbols, "calls": unresolved_calls}
    if scope not in audits:
        raise ValueError("scope is imports, symbols or calls")
    row = health(index, max_unresolved).select("n_edges", "unresolved_ratio").first()
    if row["n_edges"] and row["unresolved_ratio"] > max_unresolved:
        return {"blocked": True, "reason": f"{row['unresolved_ratio']:.0%} of calls are unresolved; the limit is {max_unresolved:.0%}"}, None
    return {"blocked": False, "reason": None}, audits[scope](index)
