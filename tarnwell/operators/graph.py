"""The call graph: callers, callees, impact, traces, closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.paths import path_filter, required
from tarnwell.sources.store import rows_of, small, written


def edge_view(index) -> DataFrame:
    """Edges with the caller's name, file and line; one row an edge, repeats and all."""
    caller = index.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("line_start").alias("caller_line"), "file_id")
    caller = caller.join(index.files.select(F.col("id").alias("file_id"), F.col("path").alias("caller_file")), "file_id").drop("file_id")
    return index.call_edges.join(caller, "caller_id").select("caller_name", "caller_file", "caller_line", "callee_name", "callee_file", "callee_id", "caller_id", "line", "pos")


def query_edges(edges: DataFrame, *, symbols: Sequence[str] | None = None, **paths) -> DataFrame:
    """Edges by the caller's path and by either end's name."""
    out = edges.filter(path_filter(F.col("caller_file"), **paths))
    if symbols is not None:
        out = out.filter(F.col("caller_name").isin(*symbols) | F.col("callee_name").isin(*symbols))
    return out


def callers(edges: DataFrame, name: str, **paths) -> DataFrame:
    required(name, "symbol")
    return query_edges(edges, **paths).filter(F.col("callee_name") == name).orderBy("caller_file", "caller_line", "line", "pos")


def callees(edges: DataFrame, name: str, **paths) -> DataFrame:
    required(name, "symbol")
    return query_edges(edges, **paths).filter(F.col("caller_name") == name).orderBy("caller_file", "caller_line", "line", "pos")


def lookup_maps(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(callers of each callee, callees of each caller): names once, in order of first occurrence."""

    def by(key: str, value: str) -> DataFrame:
        first = edges.groupBy(key, value).agg(F.min(F.struct("caller_file", "caller_line", "line", "pos")).alias("at"))
        return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("names"))

    return by("callee_name", "caller_name"), by("caller_name", "callee_name")


def call_graph_summary(edges: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """Counts of ends, and the files, callers, callees and called files that come up most."""
    top = lambda c: edges.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)
    totals = edges.agg(F.count("*").alias("n_edges"), F.count_distinct("caller_name").alias("n_callers"), F.count_distinct("callee_name").alias("n_callees"))
    return {"totals": totals, "files": top("caller_file"), "callers": top("caller_name"), "callees": top("callee_name"), "depended": top("callee_file")}


def impact(index, name: str) -> DataFrame:
    """One row: distinct (caller, file) of a name, their number, and the files that refer to it."""
    required(name, "symbol")
    who = edge_view(index).filter(F.col("callee_name") == name).select("caller_name", "caller_file").distinct()
    who = who.agg(F.array_sort(F.collect_list(F.struct("caller_file", "caller_name"))).alias("callers"), F.count("*").alias("n_callers"))
    of = index.symbols.filter(F.col("name") == name).select(F.col("id").alias("symbol_id"))
    files = index.symbol_references.join(of, "symbol_id", "left_semi").select("file_id").distinct().join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    files = files.agg(F.array_sort(F.collect_set("path")).alias("affected_files"))
    return who.join(files, F.lit(True))


def trace(edges: DataFrame, name: str, max_depth: int = 5) -> DataFrame:
    """Edges by which a name is reached, breadth first: caller, callee, file, line, depth, chain. A name is expanded at its
    least depth; of its ways there the first by file, line and name gives the chain."""
    required(name, "symbol")
    calls = written(edges.select("caller_name", "callee_name", "caller_file", "caller_line").distinct())
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(name).alias("callee_name"), F.lit(name).alias("chain"))
    seen, out = frontier.select(F.col("callee_name").alias("name")), None
    for depth in range(1, max_depth + 1):
        step = calls.join(frontier, "callee_name").join(seen.withColumnRenamed("name", "caller_name"), "caller_name", "left_anti")
        step = written(step.select("caller_name", "callee_name", "caller_file", "caller_line", F.lit(depth).alias("depth"), F.concat("caller_name", F.lit(" -> "), "chain").alias("chain")))
        out = step if out is None else out.unionByName(step)
        frontier = step.groupBy("caller_name").agg(F.min(F.struct("caller_file", "caller_line", "callee_name", "chain")).alias("s")).select(F.col("caller_name").alias("callee_name"), F.col("s.chain").alias("chain"))
        if not rows_of(step):
            break
        seen = written(seen.unionByName(frontier.select(F.col("callee_name").alias("name"))))
    return out.select(F.col("caller_name").alias("caller"), F.col("callee_name").alias("callee"), F.col("caller_file").alias("file"), F.col("caller_line").alias("line"), "depth", "chain")


def live_edges(index) -> DataFrame:
    """Distinct resolved edges whose ends are both there."""
    ids = index.symbols.select("id")
    e = index.call_edges.filter("callee_id is not null").select("callee_id", "caller_id").distinct()
    return e.join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges(callee_id, caller_id) -> symbol_id, caller_id, depth: all callers of each symbol at their least depth.

    Semi-naive: each round joins only what the last one found. Rounds are written tables, and end when one finds
    nothing. A symbol on a cycle is its own caller at the cycle's length.
    """
    step = written(edges.select(F.col("callee_id").alias("c"), F.col("caller_id").alias("up")).distinct())
    new = written(step.select(F.col("c").alias("symbol_id"), F.col("up").alias("caller_id"), F.lit(1).alias("depth")))
    out, depth = new, 1
    while rows_of(new) and (max_depth is None or depth < max_depth):
        depth += 1
        reached = new.join(step, F.col("caller_id") == F.col("c")).select("symbol_id", F.col("up").alias("caller_id")).distinct()
        new = written(reached.join(out, ["symbol_id", "caller_id"], "left_anti").withColumn("depth", F.lit(depth)))
        out = written(out.unionByName(new)) if depth % 8 == 0 else out.unionByName(new)
    return out


def changed_closure(closure: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows(symbol_id, caller_id, depth) to add, pairs(symbol_id, caller_id) to take away first) that bring a closure to
    edges(callee_id, caller_id), which are those that it was made of without `removed` and with `added`.

    Delete and rederive, with least depths. Pairs whose depth may rest on a removed edge are taken out, round by round along
    edges that fit the depths; then they are found again from pairs that are left, and pairs by way of added edges with
    them, each round going on from what the last one has found or shortened. Only symbols that reach a changed edge are
    looked at. Edges may repeat.
    """
    removed, added = written(removed.distinct()), written(added.distinct())
    pair, one = ["symbol_id", "caller_id"], F.lit(1)
    both = written(removed.unionByName(added))
    heads = both.select(F.col("callee_id").alias("caller_id")).distinct()
    sources = closure.join(small(heads, both), "caller_id", "left_semi").select("symbol_id").unionByName(heads.withColumnRenamed("caller_id", "symbol_id")).distinct()
    mine = written(closure.select(*pair, "depth").join(small(written(sources)), "symbol_id", "left_semi"))

    def onward(rows: DataFrame, by: DataFrame) -> DataFrame:
        """rows(symbol_id, caller_id, depth) one edge on."""
        step = by.select(F.col("callee_id").alias("x"), F.col("caller_id").alias("up"))
        return step.join(small(rows.withColumnRenamed("caller_id", "x"), rows), "x").groupBy("symbol_id", F.col("up").alias("caller_id")).agg((F.min("depth") + 1).alias("depth"))

    def start(by: DataFrame) -> DataFrame:
        return by.select(F.col("callee_id").alias("symbol_id"), "caller_id", one.alias("depth"))

    least = lambda rows: rows.groupBy(*pair).agg(F.min("depth").alias("depth"))
    new = written(least(onward(mine, removed).unionByName(start(removed))).join(mine, [*pair, "depth"], "left_semi"))
    gone = new
    while rows_of(new):
        new = written(onward(new, edges).join(mine, [*pair, "depth"], "left_semi").join(gone, pair, "left_anti"))
        gone = written(gone.unionByName(new))
    left = written(mine.join(gone, pair, "left_anti"))

    # again: by an edge from what is left to a pair that went, or by an added edge
    into = edges.join(small(gone.select("caller_id").distinct(), gone), "caller_id", "left_semi").select(F.col("callee_id").alias("x"), "caller_id")
    ways = gone.select(*pair).join(into, "caller_id")
    again = ways.join(left.select("symbol_id", F.col("caller_id").alias("x"), "depth"), ["symbol_id", "x"]).select(*pair, (F.col("depth") + 1).alias("depth"))
    direct = ways.filter("x = symbol_id").select(*pair, one.alias("depth"))
    new = written(least(again.unionByName(direct).unionByName(onward(left, added)).unionByName(start(added))))
    found = written(new.limit(0))
    while rows_of(new):
        known = least(left.unionByName(found)).withColumnRenamed("depth", "known")
        new = written(new.join(known, pair, "left").filter("known is null or depth < known").drop("known"))
        found = written(least(found.unionByName(new)))
        new = written(onward(new, edges))
    same = found.join(mine, [*pair, "depth"], "left_semi").select(*pair)
    dead = gone.select(*pair).unionByName(found.join(left, pair, "left_semi").select(*pair)).distinct().join(same, pair, "left_anti")
    return written(found.join(same, pair, "left_anti")), written(dead)


def blast_radius(closure: DataFrame, symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """depth, n_callers, callers of the first symbol of a name, with found, total_affected and max_depth on each row."""
    first = symbols.filter(F.col("name") == name).agg(F.min("id").alias("symbol_id"))
    rows = closure.join(F.broadcast(first), "symbol_id").join(symbols.select(F.col("id").alias("caller_id"), "name", "file_id"), "caller_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    by = rows.groupBy("depth").agg(F.count("*").alias("n_callers"), F.array_sort(F.collect_list(F.struct("name", "path"))).alias("callers"))
    return by.join(F.broadcast(by.agg(F.sum("n_callers").alias("total_affected"), F.max("depth").alias("max_depth"))), F.lit(True)).orderBy("depth")


def endpoint_flow(index, entry: str, max_depth: int = 8) -> DataFrame:
    """What an entry reaches, breadth first: id, name, kind, path, line_start, depth, calls. The entry is the first symbol
    (by id) whose name holds the text; a call leads to the first symbol of its name."""
    required(entry, "entry point")
    first = written(index.symbols.groupBy("name").agg(F.min("id").alias("id")))
    calls = written(index.call_edges.join(first.select(F.col("name").alias("callee_name"), F.col("id").alias("to")), "callee_name").select(F.col("caller_id").alias("id"), "to").distinct())
    seen = written(index.symbols.filter(F.col("name").ilike(f"%{entry}%")).agg(F.min("id").alias("id")).filter("id is not null").withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        frontier = written(frontier.select("id").join(calls, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not rows_of(frontier):
            break
        seen = seen.unionByName(frontier)
    names = index.call_edges.groupBy(F.col("caller_id").alias("id")).agg(F.array_sort(F.collect_set("callee_name")).alias("calls"))
    rows = seen.join(index.symbols, "id").join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id").join(names, "id", "left")
    return rows.select("id", "name", "kind", "path", "line_start", "depth", F.when(F.col("depth") < max_depth, F.coalesce("calls", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("calls")).orderBy("depth", "id")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges(callee_id, caller_id), starts(symbol_id) -> caller_id, depth: all that any start is called by, at the least
    depth. Only what is reached is written, so one symbol's blast radius costs its own size and not that of all pairs. A
    start is in it only if a way leads back to it."""
    step = edges.select(F.col("callee_id").alias("c"), F.col("caller_id").alias("up"))
    front, out, depth = written(starts.select(F.col("symbol_id").alias("caller_id")).distinct()), None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = step.join(small(front.select(F.col("caller_id").alias("c")), front), "c").select(F.col("up").alias("caller_id")).distinct()
        new = written((new if out is None else new.join(out, "caller_id", "left_anti")).withColumn("depth", F.lit(depth)))
        out = new if out is None else out.unionByName(new)
        out = written(out) if depth % 8 == 0 else out
        if not rows_of(new):
            break
        front = new
    return out


def blast_radius_of(index, name: str) -> DataFrame:
    """depth, n_callers of the first symbol of a name, by the symbols that it reaches alone."""
    first = index.symbols.filter(F.col("name") == name).agg(F.min("id").alias("symbol_id")).filter("symbol_id is not null")
    return reach(written(live_edges(index)), first).groupBy("depth").agg(F.count("*").alias("n_callers"))


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """values(id, color) after each id has taken the greatest color that comes to it along edges(a, b), to the end."""
    front = values
    while True:
        come = edges.join(front.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max("color").alias("come"))
        front = written(values.join(come, "id").filter("come > color").select("id", F.col("come").alias("color")))
        if not rows_of(front):
            return values
        values = written(values.join(front.withColumnRenamed("color", "more"), "id", "left").select("id", F.coalesce("more", "color").alias("color")))


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(callee_id, caller_id) -> id, component: for each symbol the least of those that call each other in a circle with
    it, itself if none does.

    Forward-backward colouring: symbols that nothing leads to or from are components of their own and go first. Then each
    takes the greatest id that leads to it as its color; what leads back to that id within its color is its component. The
    rest starts again. Rounds join the edges that are left with what the last round has moved.
    """
    e = written(edges.select(F.col("callee_id").alias("a"), F.col("caller_id").alias("b")).filter("a <> b").distinct())
    nodes = written(edges.select(F.col("callee_id").alias("id")).union(edges.select("caller_id")).distinct())
    out = []

    def without(gone: DataFrame) -> None:
        nonlocal e, nodes
        nodes = written(nodes.join(gone, "id", "left_anti"))
        e = written(e.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))

    while rows_of(nodes):
        while True:  # ends of ways
            inner = e.select(F.col("a").alias("id")).distinct().intersect(e.select("b").distinct())
            ends = written(nodes.join(inner, "id", "left_anti"))
            if not rows_of(ends):
                break
            out.append(ends.select("id", F.col("id").alias("component")))
            without(ends)
        if not rows_of(nodes):
            break
        colors = written(_spread(nodes.select("id", F.col("id").alias("color")), e))
        of = lambda c: colors.select(F.col("id").alias(c), F.col("color").alias(f"{c}_color"))
        back = written(e.join(of("a"), "a").join(of("b"), "b").filter("a_color = b_color").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_color").alias("color")))
        found = front = written(colors.filter("id = color"))
        while True:
            front = written(back.join(front.withColumnRenamed("id", "a"), ["a", "color"]).select(F.col("b").alias("id"), "color").distinct().join(found, ["id", "color"], "left_anti"))
            if not rows_of(front):
                break
            found = written(found.unionByName(front))
        least = found.groupBy("color").agg(F.min("id").alias("component"))
        out.append(written(found.join(least, "color").select("id", "component")))
        without(found.select("id"))
    every = nodes.select("id", F.col("id").alias("component"))
    for part in out:
        every = every.unionByName(part)
    return written(every)


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges(callee_id, caller_id) between components: an acyclic graph."""
    of = lambda c: components.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
    met = edges.select("callee_id", "caller_id").join(of("callee_id"), "callee_id").join(of("caller_id"), "caller_id").filter("callee_id_in <> caller_id_in")
    return met.select(F.col("callee_id_in").alias("callee_id"), F.col("caller_id_in").alias("caller_id")).distinct()
