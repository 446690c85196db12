"""Join of texts by Jaccard similarity of their word shingles, with prefix filters under several token orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.llm.common import BROADCAST_ROWS, counted, discard, materialize, release, row_key, rows_of, small, table, thin
from tarnwell.llm.components import joined
from tarnwell.llm.hashing import CHUNK, mix, pieces, word_hashes

SHINGLE, PERCENT = 5, 80
#: Buckets of the frequency table that orders tokens; token orders that a pair must share prefix tokens under.
BUCKETS, ORDERS = 1 << 18, 3
#: Prefixes are longer than they must be by a token for each SLACK tokens of a set; pairs must share as many more.
SLACK = 12
#: Groups of a token with up to FEW members give their pairs at once; larger ones give those with one member a round, for
#: ROUNDS rounds, and then the pairs that are left between components.
FEW, ROUNDS = 16, 2
#: Members of a block, of which two are compared in a task.
BLOCK = 256
_MULTIPLY = np.random.default_rng(5).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(6).integers(1, 2**63, ORDERS, dtype=np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; fewer words than a shingle are one, none give none."""
    h, of = word_hashes(texts)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        rows = max(0, len(h) - SHINGLE + 1)
        g = np.zeros(rows, np.uint64)
        for k in range(SHINGLE):
            g += h[k : k + rows] * _MULTIPLY[k]
        g = mix(g)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(h[a:b] * _MULTIPLY[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    """So many tokens that come first under any order, that sets as similar as asked for share more than n // SLACK of them."""
    return min(n, n - -(-PERCENT * n // 100) + 1 + n // SLACK)


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The prefix under the first order: by the frequency of a token's bucket in all texts (in steps of half a power of
    two), then by a hash."""
    size = prefix_size(len(s))
    if size >= len(s):
        return s
    with np.errstate(over="ignore"):
        h = mix(s ^ _SALT[0])
    return s[np.lexsort((h, levels[(s % np.uint64(BUCKETS)).astype(np.int64)]))[:size]]


def _tally(batches):
    sums = np.zeros(BUCKETS, np.int64)
    for _, texts in pieces(batches, "text"):
        sums += np.bincount((np.concatenate(shingle_sets(texts)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(sums)
    for a in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_pydict({"bucket": at[a : a + 50_000].astype(np.int32), "n": sums[at[a : a + 50_000]]})


def _prefixes(shared):
    def run(batches):
        for batch, texts in pieces(batches, "text"):
            sets = shingle_sets(texts)
            first = [prefix(s, shared.value).view(np.int64) for s in sets]
            sign = lambda k: pa.array(np.array([mix(s ^ np.uint64(k)).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), sign(77), sign(78), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "key", "n", "s1", "s2", "prefix"])

    return run


def other_prefixes(s: np.ndarray) -> list[np.ndarray]:
    """The prefixes of a set under the orders beside the first, which are by hashes alone; tokens stand as those hashes."""
    size = prefix_size(len(s))
    with np.errstate(over="ignore"):
        hashed = [mix(s ^ salt) for salt in _SALT[1:]]
    return [h if size >= len(h) else np.partition(h, size - 1)[:size] for h in hashed]


SETS = "node long, n int, tokens array<long>, others array<array<long>>"


def _sets(batches):
    kind = pa.list_(pa.int64())
    for batch, texts in pieces(batches, "text"):
        sets = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], kind), pa.array([[h.view(np.int64) for h in other_prefixes(s)] for s in sets], pa.list_(kind))],
            ["node", "n", "tokens", "others"],
        )


def _verify(batches):
    """Of pairs of texts: how many shingles both have, and whether those are enough."""
    for batch in batches:
        a, b = batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()
        distinct = list(dict.fromkeys(a + b))
        sets: dict[str, np.ndarray] = {}
        lo = size = 0
        for k, t in enumerate(distinct):
            size += len(t)
            if size > CHUNK or k == len(distinct) - 1:
                sets.update(zip(distinct[lo : k + 1], shingle_sets(distinct[lo : k + 1])))
                lo, size = k + 1, 0
        both = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)]
        linked = [100 * c >= PERCENT * (len(sets[x]) + len(sets[y]) - c) for x, y, c in zip(a, b, both)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(both, pa.int32())], ["a", "b", "linked", "common"])


def _near(x: Column, y: Column) -> Column:
    """Whether sets (n tokens, t of them in other sets too) can be similar enough, by size and by what they can share."""
    sizes = F.lit(PERCENT) * F.greatest(x["n"], y["n"]) <= 100 * F.least(x["n"], y["n"])
    return sizes & ((100 + PERCENT) * F.least(x["t"], y["t"]) >= PERCENT * (x["n"] + y["n"]))


def _levels(d: DataFrame) -> np.ndarray:
    """The step of each bucket's frequency. BUCKETS rows at most reach the driver."""
    found = d.select("text").mapInArrow(_tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    usual = max(1.0, float(np.median(counts)))
    return np.maximum(0, np.floor(2 * np.log2(np.maximum(counts, 1) / usual))).astype(np.int8)


def _alive(listed: DataFrame) -> DataFrame:
    """The classes with enough tokens in company: with fewer than any pair of it shares, a class takes part in none."""
    needed = F.floor(F.col("n") * PERCENT / (100 * SLACK))
    return materialize(listed.groupBy("node", "n").agg(F.count("*").alias("live")).filter(F.col("live") > needed).select("node"))


def _members() -> Column:
    return F.count("*").over(W.partitionBy("token"))


def _company(classes: DataFrame, d: DataFrame) -> DataFrame:
    """node, text of the classes that share enough prefix tokens of the first order with any others."""
    listed = classes.select("node", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    listed = materialize(listed.withColumn("members", _members()).filter("members > 1"))
    alive = _alive(listed)
    keys = materialize(classes.select("node", "key").join(alive, "node", "left_semi"))
    texts = materialize(d.select("key", "text").join(small(keys), "key").select("node", "text").dropDuplicates(["node"]))
    discard(listed, alive, keys)
    return texts


def _listed(sets: DataFrame, few: int) -> DataFrame:
    """token (null for groups of up to `few`), m: members (node, n, t: their tokens in company) of each token's group.

    Classes are listed by the exact number of sets that hold a token, rarest first.
    """
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    held = each.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("t"))
    size = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 + F.floor(F.col("n") / SLACK)
    first = F.slice("t", F.lit(1), F.greatest(size - (F.col("n") - F.size("t")), F.lit(0)).cast("int"))
    held = held.filter(100 * F.size("t") >= PERCENT * F.col("n"))
    again = materialize(held.select("node", "n", F.size("t").alias("t"), F.explode(first).alias("x")).select("node", "n", "t", "x.token").withColumn("members", _members()).filter("members > 1"))
    alive = _alive(again)
    pruned = materialize(again.drop("members").join(small(alive), "node", "left_semi").withColumn("members", _members()).filter("members > 1"))
    one = F.struct("node", "n", "t")
    lone = pruned.filter(F.col("members") <= few).groupBy("token").agg(F.collect_list(one).alias("m")).select(F.lit(None).cast("long").alias("token"), "m")
    out = materialize(lone.unionByName(pruned.filter(F.col("members") > few).select("token", F.array(one).alias("m"))))
    discard(again, alive, pruned)
    return out


def _as_pairs(df: DataFrame, x: str, y: str, *more: str) -> DataFrame:
    return df.select(F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b"), F.least(f"{x}.n", f"{y}.n").alias("least"), *more)


def _pairs_of_few(listed: DataFrame) -> DataFrame:
    """a, b, least, shared: pairs of the groups with few members, with the number of tokens that they share there."""
    member = lambda i: F.get("m", i)
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: F.struct(member(i).alias("x"), member(j).alias("y")))))
    pairs = listed.filter("token is null").select(F.explode(F.filter(two, lambda p: _near(p["x"], p["y"]))).alias("p"))
    return counted(_as_pairs(pairs, "p.x", "p.y").groupBy("a", "b", "least").agg(F.count("*").alias("shared")))


def _pairs_with_one(live: DataFrame) -> DataFrame:
    """a, b, least, more: each group's members with one of them, with the number of groups that they meet in."""
    drawn = live.filter("root <> one.root").select(F.col("one.m").alias("x"), F.col("m").alias("y"))
    return _as_pairs(drawn.filter(_near(F.col("x"), F.col("y"))), "x", "y").groupBy("a", "b", "least").agg(F.count("*").alias("more"))


def _pairs_left(live: DataFrame, hubs: DataFrame, shares: DataFrame | None, block: int) -> DataFrame:
    """a, b, least, more: all pairs of a group that no links connect yet and that could be similar enough.

    What two sets share is in their group's hub, or in neither more than each has beside the hub's, which bounds it. A group
    is dealt into blocks of about `block` members, and a task compares two blocks, so that no group gathers in one task.
    """
    at = live.select("token", "m", "root", F.col("m.node").alias("node")).join(hubs, "token", "left")
    at = at.join(shares, ["node", "hub"], "left") if shares is not None else at.withColumn("c", F.lit(None).cast("int"))
    at = at.join(live.groupBy(F.col("m.node").alias("node")).agg(F.collect_list("token").alias("own")), "node")
    blocks = live.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    at = at.join(small(blocks), "token").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = at.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1))).alias("l")
    right = at.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).alias("r")
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    most = F.least("l.c", "r.c") + F.least(F.col("l.m.t") - F.col("l.c"), F.col("r.m.t") - F.col("r.c"))
    could = F.col("l.c").isNull() | F.col("r.c").isNull() | ((100 + PERCENT) * most >= PERCENT * (F.col("l.m.n") + F.col("r.m.n")))
    once = (F.col("l.i") < F.col("l.j")) | (F.col("l.node") < F.col("r.node"))
    apart = once & (F.col("l.root") != F.col("r.root")) & _near(F.col("l.m"), F.col("r.m"))
    # a pair comes up at the least of the tokens that both have
    mine = F.array_intersect("l.own", "r.own")
    drawn = left.join(right, same & apart & could & (F.array_min(mine) == F.col("l.token")))
    return _as_pairs(drawn.select(F.col("l.m").alias("x"), F.col("r.m").alias("y"), F.size(mine).alias("more")), "x", "y", "more")


def _ends(pairs: DataFrame, values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """pairs(a, b), counted, with a_<name> and b_<name> from values(node, name, ...): each end's values go to its pairs, and
    a pair's two ends meet there, in one shuffle."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    met = values.join(F.broadcast(ends) if 2 * rows_of(pairs) <= BROADCAST_ROWS else ends, "node")
    held = F.struct(*names)
    side = lambda c: F.max_by(F.when(F.col("node") == F.col(c), held), F.when(F.col("node") == F.col(c), F.lit(1))).alias(f"{c}_end")
    both = met.groupBy("a", "b").agg(side("a"), side("b"))
    return both.select("a", "b", *[F.col(f"{c}_end.{n}").alias(f"{c}_{n}") for c in "ab" for n in names])


def _under_all_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) that share enough prefix tokens under each of the other orders too: filters meet before texts do."""
    met = _ends(pairs, sets, ("n", "others"))
    need = F.floor(F.least("a_n", "b_n") / SLACK)
    common = F.zip_with("a_others", "b_others", lambda x, y: F.size(F.array_intersect(x, y)))
    return counted(thin(met.filter(F.forall(common, lambda c: c > need)).select("a", "b"), rows_of(pairs), 1000))


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked, common: pairs verified by their whole sets."""
    met = thin(_ends(pairs, texts, ("text",)), rows_of(pairs), 200)
    return counted(met.mapInArrow(_verify, "a long, b long, linked boolean, common int"))


def _links(listed: DataFrame, sets: DataFrame, texts: DataFrame, rounds: int, block: int) -> DataFrame | None:
    """node, root: the components of all links, found by links enough to connect them; none without links."""
    base = _pairs_of_few(listed)
    groups = listed.filter("token is not null").select("token", F.get("m", F.lit(0)).alias("m"))
    enough = F.col("shared") > F.floor(F.col("least") / SLACK)
    pairs = base.filter(enough).select("a", "b")
    done = roots = hubs = shares = None
    n_groups = groups.count()
    for turn in range(rounds + 2 if n_groups else 1):
        every = live = None
        if turn:
            live = groups.select("token", F.col("m.node").alias("node"), "m")
            live = live.join(small(roots), "node", "left") if roots is not None else live.withColumn("root", F.lit(None).cast("long"))
            every = live = counted(live.select("token", "m", F.coalesce("root", "node").alias("root")))
            # first the members with the fewest tokens of their own, which are nearest to most; then any
            lead = (F.xxhash64("m.node", F.lit(turn)) if turn > 2 else (F.col("m.n") - F.col("m.t")).cast("long") * 2 + F.pmod(F.xxhash64("m.node", F.lit(turn)), F.lit(2))).alias("lead")
            spread = live.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(lead, "m", "root")).alias("one")).filter("low <> high").select("token", "one")
            spread = counted(thin(spread, n_groups))
            live = counted(live.join(small(spread), "token"))
            hubs = counted(spread.select("token", F.col("one.m.node").alias("hub"))) if turn == 1 else hubs
            discard(spread)
            if not rows_of(live):
                discard(every, live)
                break
            drawn = _pairs_with_one(live) if turn <= rounds else _pairs_left(live, hubs, shares, block)
            both = drawn.join(base.select("a", "b", "shared"), ["a", "b"], "left").withColumn("shared", F.col("more") + F.coalesce("shared", F.lit(0)))
            pairs = both.filter(enough).select("a", "b")
            pairs = pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs
            # a member gives a pair with the drawn one at most
            pairs = thin(pairs, rows_of(live)) if turn <= rounds else pairs
        pairs = counted(pairs)
        discard(every, live)
        if not rows_of(pairs):
            continue
        passed = _under_all_orders(pairs, sets)
        checked = _checked(passed, texts)
        if turn == 1:
            way = lambda x, y: checked.select(F.col(x).alias("node"), F.col(y).alias("hub"), F.col("common").alias("c"))
            shares = counted(way("a", "b").unionByName(way("b", "a")))
        done = pairs if done is None else done.unionByName(pairs)
        new = counted(thin(checked.filter("linked").select("a", "b"), rows_of(checked)))
        if rows_of(new):
            last, roots = roots, joined(roots, new)
            discard(last)
        discard(passed, new)
        release(texts.sparkSession)
    return roots


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """key, doc_id, n_shingles, component_id, root: one row a document (root names its component, null without shingles).

    Texts of one set are one class from the start (told by two 64-bit sums and the size); what follows is about classes.
    Pairs must share more than a twelfth of the smaller set as prefix tokens under each of several token orders. The first
    order, rarest first, draws the pairs: classes with fewer tokens in company than that are set aside, and those that are
    left are listed again by the exact number of them that hold a token. Its pairs are intersected with what the other
    orders let pass, by the prefixes alone, and only the rest is verified by whole texts. Tokens of few classes give their
    pairs at once. Those of many first give pairs with one member at a time, and pairs whose classes are connected by then
    are not compared, so a group of thousands of near copies takes about as many comparisons as it has members; all pairs
    that could still connect components follow, block by block.

    Null and empty texts have no shingles and are their own component; an empty table gives no rows. Texts of any length
    are taken whole. A component's id is its smallest document id (null ids aside), so ties don't matter. Repeated rows are
    in one class. Columns other than id and text are not looked at, so their names can't clash.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    shared = spark.sparkContext.broadcast(_levels(d))
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = materialize(d.mapInArrow(_prefixes(shared), f"doc_id {kind}, key string, n long, s1 long, s2 long, prefix array<bigint>"))
    classes = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("key"), F.first("prefix").alias("prefix"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers hold from here on, as the table is read back
    # prefixes are most of these tables and serve only to find company
    named = materialize(rows.drop("prefix"))
    discard(rows)
    release(spark)
    texts = _company(classes, d)
    nodes = materialize(classes.select("n", "s1", "s2", "node"))
    discard(classes)
    sets = materialize(texts.mapInArrow(_sets, SETS))
    release(spark)
    listed = _listed(sets, few)
    release(spark)
    roots = _links(listed, sets, texts, rounds, block)
    discard(texts, sets, listed)
    return _named(named, nodes, roots)


def _named(rows: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    full = rows.filter("n > 0").select("doc_id", "key", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"])
    named = full.groupBy("node").agg(F.min("doc_id").alias("low"))
    if roots is not None:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
        named = named.join(ids, "root").select("node", "component_id", "root")
    else:
        named = named.select("node", F.col("low").alias("component_id"), F.col("node").alias("root"))
    out = full.join(named, "node").select("key", "doc_id", F.col("n").alias("n_shingles"), "component_id", "root")
    return out.unionByName(rows.filter("n = 0").select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
