"""Building the index from source files, whole and by change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.functions import extract
from tarnwell.operators import graph, resolve
from tarnwell.plans import schema
from tarnwell.plans.index import CodeIndex
from tarnwell.plans.schema import PER_FILE
from tarnwell.sources import tree
from tarnwell.sources.scan import detect_language
from tarnwell.sources.segments import Segments
from tarnwell.sources.store import rows_of, small, steps, written

#: Ids that a file can have.
ROOM = (1 << 63) // PER_FILE


def with_ids(paths: DataFrame, taken: DataFrame | None = None, room: int = ROOM) -> DataFrame:
    """paths(path, ...) with id: a hash of the path, so ids don't shift when other files come and go. A path whose hash
    another path has, or taken(id, path) of earlier ones, is hashed anew until no two paths share an id."""
    ident = lambda salt: F.pmod(F.xxhash64("path", F.lit(salt)), F.lit(room))
    named = written(paths.select("path").distinct().withColumn("id", ident(0)))
    held = taken.select("id", "path", F.lit(0).alias("late")) if taken is not None else None
    if held is not None:
        known = held.select("path", F.col("id").alias("old")).join(small(named.select("path"), named), "path", "left_semi")
        named = written(named.join(known, "path", "left").select("path", F.coalesce("old", "id").alias("id")))
    salt = 0
    while True:
        every = named.withColumn("late", F.lit(1))
        if held is not None:
            # of earlier ids only those at stake: they are many, and a change is small
            near = held.join(small(named.select("id"), named), "id", "left_semi")
            every = every.join(near.select("path"), "path", "left_anti").select("id", "path", "late").unionByName(near)
        first = every.groupBy("id").agg(F.min(F.struct("late", "path")).alias("one"), F.count("*").alias("n")).filter("n > 1").select("id", "one.path")
        lost = written(named.join(first.withColumnRenamed("path", "first"), "id").filter("path <> first").select("path"))
        if not rows_of(lost):
            return paths.join(named, "path")
        salt += 1
        named = written(named.join(lost.withColumn("again", F.lit(True)), "path", "left").select("path", F.when(F.col("again"), ident(salt)).otherwise(F.col("id")).alias("id")))


def file_table(sources: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """sources(path, content, ...) -> id, path, lang, mtime, hash, content, with ids beside those in taken(id, path)."""
    have = set(sources.columns)
    return with_ids(sources, taken).select(
        "id", "path", (F.col("lang") if "lang" in have else detect_language(F.col("path"))).alias("lang"), (F.col("mtime") if "mtime" in have else F.lit(0.0)).alias("mtime"),
        F.md5(F.col("content").cast("binary")).alias("hash"), "content",
    )


def build(spark: SparkSession, sources: DataFrame, with_closure: bool = True) -> CodeIndex:
    """sources(path, content) -> the index: each file is read and parsed once, all else is joins over the facts."""
    files = written(file_table(sources))
    facts = written(extract.extract(files.filter("lang is not null")))
    return assemble(spark, files, facts, with_closure)


def split_lines(files: DataFrame) -> DataFrame:
    split = files.select(F.col("id").alias("file_id"), F.posexplode(F.split("content", "\r?\n")).alias("p", "text"), F.size(F.split("content", "\r?\n")).alias("n"))
    return split.filter("not (p = n - 1 and text = '' and n > 1)").select("file_id", (F.col("p") + 1).alias("line_no"), "text")


def of_kind(facts: DataFrame, fact: str) -> DataFrame:
    return facts.filter(F.col("fact") == fact)


def file_symbols(meta: DataFrame, facts: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("file_id").orderBy("line_start", F.desc("line_end"), "kind", "name"))
    symbols = of_kind(facts, "symbol").select("file_id", "name", "kind", "line_start", "line_end").withColumn("id", F.col("file_id") * PER_FILE + place)
    symbols = symbols.join(meta.select(F.col("id").alias("f_id"), "path", "lang"), F.col("file_id") == F.col("f_id"))
    return symbols.select("id", "file_id", "name", "kind", "line_start", "line_end", resolve.qualified_name(F.col("path"), F.col("lang"), F.col("name")).alias("qualified_name"))


def file_calls(facts: DataFrame) -> DataFrame:
    order = F.row_number().over(W.partitionBy("file_id", "line_start").orderBy("name")) - 1
    return of_kind(facts, "call").filter(resolve.is_call_name(F.col("name"))).select("file_id", F.col("line_start").alias("line"), order.cast("int").alias("pos"), F.col("name").alias("callee_name"))


def file_imports(facts: DataFrame) -> DataFrame:
    imports = of_kind(facts, "import").select("file_id", F.col("name").alias("module"), "level", F.col("flag").alias("is_star"), "line_start")
    newest = F.row_number().over(W.partitionBy("file_id", "module").orderBy(F.desc("line_start")))
    imports = imports.withColumn("r", newest).filter("r = 1").drop("r", "line_start")
    return imports.withColumn("id", F.col("file_id") * PER_FILE + F.row_number().over(W.partitionBy("file_id").orderBy("module"))).select("id", "file_id", "module", "level", "is_star")


def file_docstrings(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    last = F.row_number().over(W.partitionBy("file_id", "name").orderBy(F.desc("line_start")))
    docs = of_kind(facts, "docstring").withColumn("r", last).filter("r = 1").select("file_id", "name", F.col("detail").alias("content"), "line_start", "line_end")
    docs = resolve.first_by_name(docs.withColumnsRenamed({"line_start": "d_start", "line_end": "d_end"}), symbols)
    return docs.select("file_id", "symbol_id", "content", F.col("d_start").alias("line_start"), F.col("d_end").alias("line_end"))


def file_hints(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    hints = of_kind(facts, "hint").select("file_id", "name", F.split("detail", "\x01")[0].alias("param_name"), F.split("detail", "\x01")[1].alias("annotation"), F.col("flag").alias("is_return"))
    return resolve.first_by_name(hints, symbols).select("file_id", "symbol_id", F.nullif("param_name", F.lit("")).alias("param_name"), "annotation", "is_return")


def file_tokens(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, line, name of names that don't define a symbol where they stand."""
    names = of_kind(facts, "name").select("file_id", F.col("line_start").alias("line"), "name")
    return names.join(symbols.select("file_id", F.col("line_start").alias("line"), "name"), ["file_id", "line", "name"], "left_anti")


def from_facts(facts: DataFrame) -> dict[str, DataFrame]:
    """Relations that are facts as they are."""
    of = lambda fact: of_kind(facts, fact)
    return {
        "name_uses": of("name").select("file_id", "name"), "imported_names": of("imported").select("file_id", F.col("detail").alias("module"), "name", "level", F.col("flag").alias("is_star")),
        "bare_calls": of("call").filter("flag").select("file_id", "name").distinct(), "decorated": of("decorated").select("file_id", "name").distinct(),
    }


def assemble(spark: SparkSession, files: DataFrame, facts: DataFrame, with_closure: bool = True) -> CodeIndex:
    meta = files.select("id", "path", "lang", "mtime", "hash")
    symbols = written(file_symbols(meta, facts))
    calls, imports = written(file_calls(facts)), file_imports(facts)
    edges = written(resolve.resolve_callees(resolve.enclosing_symbol(calls, symbols), symbols, imports, meta))
    references = resolve.references_near(file_tokens(facts, symbols), symbols)
    out = CodeIndex.empty(
        spark, files=meta, lines=split_lines(files), symbols=symbols, calls=calls, call_edges=edges, imports=imports, symbol_references=references, docstrings=file_docstrings(facts, symbols).drop("file_id"),
        type_hints=file_hints(facts, symbols).drop("file_id"), **from_facts(facts),
    )
    if with_closure:
        out.closure = graph.closure(graph.live_edges(out))
    return out


def build_tree(spark: SparkSession, root: str, **options) -> CodeIndex:
    return build(spark, tree.scan(spark, root), **options)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state (new, changed, unchanged or deleted) between two file tables, by content hash."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full").select("path", state.alias("state"))


def cascade(index: CodeIndex, gone: DataFrame) -> CodeIndex:
    """The index without the files in gone(id) and all that hangs on them; calls into them lose their target."""
    symbols = index.symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    kept = symbols.select("id")
    by_file = {n: getattr(index, n).join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti") for n in ("lines", "calls", "imports", "name_uses", "imported_names", "bare_calls", "decorated")}
    of = lambda n, key="symbol_id": getattr(index, n).join(kept.withColumnRenamed("id", key), key, "left_semi")
    edges = of("call_edges", "caller_id")
    alive = kept.select(F.col("id").alias("callee_id"), F.lit(True).alias("alive"))
    edges = edges.join(alive, "callee_id", "left")
    keep = lambda c: F.when(F.col("alive"), F.col(c)).alias(c)
    edges = edges.select("caller_id", "callee_name", "line", "pos", keep("callee_id"), keep("resolved_name"), keep("callee_file"))
    tables = index.tables() | by_file | {"symbols": symbols, "call_edges": edges, "files": index.files.join(gone.select("id"), "id", "left_anti")}
    tables |= {n: of(n) for n in ("symbol_references", "docstrings", "type_hints", "embeddings", "git_history")}
    tables["closure"] = of("closure").join(kept.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")
    return CodeIndex(**{n: tables[n].select(*index.tables()[n].columns) for n in index.tables()})


def last_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key that of the greatest order; rows that tie in it go by their other columns."""
    rest = [c for c in rows.columns if c not in order]
    last = F.max(F.struct(*order, *rest)).alias("r")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(last).select("r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new instead of rows of old with their key; of new rows with one key the last by `order` stays (columns that
    old may lack), or without an order the greatest."""
    last = last_by(new, key, order or [c for c in new.columns if c not in key])
    return old.join(new.select(*key), key, "left_anti").unionByName(last.select(*old.columns))


#: Relations of a Store at rest and their keys: a row belongs to a file, but calls and references may change without it.
RELATIONS = {
    "files": ("id long, path string, lang string, mtime double, hash string, content string", ["id"]),
    "facts": (extract.FACT, ["file_id"]),
    "symbols": (schema.SYMBOLS, ["file_id"]),
    "imports": (schema.IMPORTS, ["file_id"]),
    "docstrings": (f"file_id long, {schema.DOCSTRINGS}", ["file_id"]),
    "type_hints": (f"file_id long, {schema.TYPE_HINTS}", ["file_id"]),
    "calls": ("file_id long, line int, pos int, callee_name string, caller_id long, callee_id long, resolved_name string, callee_file string", ["file_id", "line", "pos"]),
    "names": ("file_id long, line int, name string, symbol_id long", ["file_id", "line", "name"]),
    "closure": (schema.CLOSURE, ["symbol_id", "caller_id"]),
}


class Store:
    """An index at rest that is maintained by change, batch by batch.

    Only changed files are parsed. Calls and names of other files are resolved again only where the change moves their
    target: where a name that the changed files define, or did, has another only definition than before, or where a
    qualified name that such a file imports has. The closure, if it is asked for, follows by the call pairs that came and
    went. What a batch writes is what changed; of other tables it reads the columns that it compares, and shuffles none of them as long as the
    change itself is small enough to broadcast.
    """

    def __init__(self, spark: SparkSession, path: str, with_closure: bool = False, on_event: Callable[[dict], None] | None = None):
        """on_event gets each batch's start, and its end (`done` with files indexed, skipped as they are the same, and deleted,
        and the rows written) or `error`; the numbers are taken while the batch is written."""
        self.spark, self.with_closure, self.on_event = spark, with_closure, on_event or (lambda event: None)
        self.at = Segments(spark, path, RELATIONS if with_closure else {n: r for n, r in RELATIONS.items() if n != "closure"})

    def version(self) -> int:
        return self.at.version()

    def live(self, name: str) -> DataFrame:
        return self.at.live(name).drop("born")

    def touched(self) -> dict[str, tuple[int, int]]:
        """Rows that the last batch added to and took from each relation."""
        return {n: (m["added"], m["buried"]) for n, m in self.at.mark().items()}

    def apply(self, upserts: DataFrame | None, deletes: DataFrame | None = None, order: list[str] | None = None) -> int:
        """upserts(path, content) and deletes(path) on the current version; files of the same hash are not parsed again. Of
        several contents of a path the last by `order` holds (columns of upserts), without one the greatest. Returns the
        version then, the same as before if nothing has changed."""
        self.on_event({"event": "start", "version": self.version() + 1})
        seen = Observation()
        try:
            with steps(self.spark):
                version, indexed, lost = self._apply(upserts, deletes, order, seen)
        except Exception as e:
            self.on_event({"event": "error", "message": f"{type(e).__name__}: {e}"[:500]})
            raise
        files = seen.get.get("n", 0) if upserts is not None else 0
        rows = sum(a for a, _ in self.touched().values()) if indexed or lost else 0
        self.on_event({"event": "done", "version": version, "indexed": indexed, "skipped": files - indexed, "deleted": lost, "rows": rows})
        return version

    def _apply(self, upserts: DataFrame | None, deletes: DataFrame | None, order: list[str] | None, seen: Observation) -> tuple[int, int, int]:
        now = self.version()
        n, put, live = now + 1, self.at.put, self.at.live
        self.at.clean(n)
        old = live("files").select("id", "path", "hash", "born")
        gone = deletes.select("path") if deletes is not None else self.spark.createDataFrame([], "path string")
        fresh = self.spark.createDataFrame([], RELATIONS["files"][0])
        if upserts is not None:
            files = file_table(last_by(upserts, ["path"], order or ["content"]), old.select("id", "path")).join(gone, "path", "left_anti")
            same = old.select("path", "hash").join(small(files.select("path")), "path", "left_semi")
            fresh = files.observe(seen, F.count(F.lit(1)).alias("n")).join(same, ["path", "hash"], "left_anti")
        fresh = put(n, "files", fresh)
        gone = gone.unionByName(fresh.select("path")).distinct()
        lost = written(old.join(small(gone), "path", "left_semi").select("id", "born", "path"))
        if not self.at.added(n, "files") and not rows_of(lost):
            self.at.clean(n)
            return now, 0, 0
        deleted = lost.join(small(fresh.select("path")), "path", "left_anti").count()
        put(n, "files", None, lost)
        facts = put(n, "facts", extract.extract(fresh.filter("lang is not null")))
        self._derive(n, fresh, facts, lost)
        indexed = self.at.commit(n)["files"]["added"]
        return self.at.merge() if self.at.due() else n, indexed, deleted

    def _derive(self, n: int, fresh: DataFrame, facts: DataFrame, gone: DataFrame) -> None:
        """What hangs on changed files (fresh(id, ...) with their facts, and gone(id, born) of versions that went)."""
        put, live = self.at.put, self.at.live
        of_lost = gone.select(F.col("id").alias("file_id"), "born")
        lost = small(of_lost.select("file_id"), gone)
        ended = lambda name: live(name).join(lost, "file_id", "left_semi")
        kept = lambda name: live(name).join(lost, "file_id", "left_anti")
        meta = fresh.select("id", "path", "lang", "mtime", "hash")
        # these are born and end with their file
        put(n, "facts", None, of_lost)
        before = written(ended("symbols"))
        symbols = put(n, "symbols", file_symbols(meta, facts), of_lost)
        imports = put(n, "imports", file_imports(facts), of_lost)
        put(n, "docstrings", file_docstrings(facts, symbols), of_lost)
        put(n, "type_hints", file_hints(facts, symbols), of_lost)
        every = kept("symbols").unionByName(symbols)
        moved, requalified = self._moved(before, symbols, every)

        # calls of the changed files, and calls elsewhere whose target the change may move
        own = file_calls(facts)
        own = own.join(resolve.enclosing_symbol(own, symbols).select("file_id", "line", "pos", "caller_id"), ["file_id", "line", "pos"], "left")
        others = kept("calls").filter("caller_id is not null")
        all_imports = kept("imports").unionByName(imports)
        through = requalified.join(all_imports.select("module", "file_id").distinct(), "module").select("file_id", "callee_name").distinct()
        by_name = others.join(small(moved.withColumnRenamed("name", "callee_name"), moved), "callee_name", "left_semi")
        by_module = others.join(small(through), ["file_id", "callee_name"], "left_semi")
        call = ["file_id", "line", "pos", "callee_name", "caller_id"]
        again = written(by_name.unionByName(by_module).select(*call, "callee_id", "born").distinct())
        todo = written(own.unionByName(again.select(*call)))
        wanted = small(todo.select(F.col("callee_name").alias("name")).distinct(), todo)
        callers = small(todo.select(F.col("caller_id").alias("id")).distinct(), todo)
        targets = every.join(wanted, "name", "left_semi")
        targets = written(targets.unionByName(every.join(wanted, "name", "left_anti").join(callers, "id", "left_semi")))
        paths = live("files").join(lost.withColumnRenamed("file_id", "id"), "id", "left_anti").select("id", "path").unionByName(meta.select("id", "path"))
        paths = paths.join(small(targets.select(F.col("file_id").alias("id")).distinct(), targets), "id", "left_semi")
        near = all_imports.join(small(todo.select("file_id").distinct(), todo), "file_id", "left_semi")
        found = resolve.resolve_callees(todo.filter("caller_id is not null"), targets, near, paths, keep=("file_id",))
        outside = todo.filter("caller_id is null").select(*call).selectExpr("*", "cast(null as long) callee_id", "cast(null as string) resolved_name", "cast(null as string) callee_file")
        dead_calls = written(ended("calls").select(*call, "callee_id", "born").unionByName(again.select(*call, "callee_id", "born")))
        calls = put(n, "calls", found.select(*call, "callee_id", "resolved_name", "callee_file").unionByName(outside), dead_calls)

        # names likewise
        stale = kept("names").join(small(moved, moved), "name", "left_semi")
        tokens = file_tokens(facts, symbols).unionByName(stale.select("file_id", "line", "name"))
        tokens = written(tokens)
        known = every.join(small(tokens.select("name").distinct(), tokens), "name", "left_semi")
        put(n, "names", resolve.references_near(tokens, known, every=True), ended("names").unionByName(stale))
        if self.with_closure:
            pairs = lambda rows: rows.filter("callee_id is not null and caller_id is not null").select("callee_id", "caller_id")
            one = ["callee_id", "caller_id"]
            left = live("calls").join(small(dead_calls.select("file_id", "line", "pos", "born"), dead_calls), ["file_id", "line", "pos", "born"], "left_anti")
            after = pairs(left).unionByName(pairs(calls))
            went, came = written(pairs(dead_calls).distinct()), written(pairs(calls).distinct())
            removed = went.join(after.join(small(went), one, "left_semi"), one, "left_anti")
            added = came.join(pairs(live("calls")).join(small(came), one, "left_semi"), one, "left_anti")
            new, dead = graph.changed_closure(live("closure").drop("born"), after, removed, added)
            dead = live("closure").select("symbol_id", "caller_id", "born").join(small(dead), ["symbol_id", "caller_id"], "left_semi")
            put(n, "closure", new, dead)

    def _moved(self, before: DataFrame, after: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(name) of the names whose only symbol is another than before, if there was or is one, and (module, callee_name) of
        the qualified names that lead to another symbol."""

        def differs(key: str, one) -> DataFrame:
            at_stake = small(before.select(key).unionByName(after.select(key)).distinct())
            was = self.at.live("symbols").join(at_stake, key, "left_semi").groupBy(key).agg(one.alias("was"))
            now = every.join(at_stake, key, "left_semi").groupBy(key).agg(one.alias("now"))
            return was.join(now, key, "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select(key)

        names = written(differs("name", F.when(F.count("*") == 1, F.min("id"))))
        q = F.col("qualified_name")
        qualified = written(differs("qualified_name", F.min("id")).select(F.regexp_replace(q, r"\.[^.]*$", "").alias("module"), F.substring_index(q, ".", -1).alias("callee_name")))
        return names, qualified

    def index(self, with_closure: bool = True) -> CodeIndex:
        """The current version's relations, as they are at rest."""
        files, facts, calls = self.live("files"), self.live("facts"), self.live("calls")
        meta = files.select("id", "path", "lang", "mtime", "hash")
        edges = calls.filter("caller_id is not null").select("caller_id", "callee_name", "line", "pos", "callee_id", "resolved_name", "callee_file")
        out = CodeIndex.empty(
            self.spark, files=meta, lines=split_lines(files), symbols=self.live("symbols"), calls=calls.select("file_id", "line", "pos", "callee_name"), call_edges=edges, imports=self.live("imports"), docstrings=self.live("docstrings").drop("file_id"),
            type_hints=self.live("type_hints").drop("file_id"), symbol_references=self.live("names").filter("symbol_id is not null").select("symbol_id", "file_id", "line"), **from_facts(facts),
        )
        if with_closure:
            out.closure = self.live("closure") if self.with_closure else graph.closure(graph.live_edges(out))
        return out
