"""Audit of how sources of a language differ: distances between sources, and the terms that each overuses most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.llm.common import ascii_lower, discard, materialize, small, table, words

#: What stands between terms, which are of letters and of all beyond ASCII.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in at least; added to each count; what probabilities are whole parts of.
LEAST_DOCS, SMOOTH, SCALE = 30, 5, 1_000_000_000
TOP = 50
#: Sources of a term that are paired in one task at most, squared.
BLOCK = 256
GROUP = ["lang", "source"]


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)) in whole numbers; decimals hold what a long can't. Null without
    terms."""
    parts = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(24,0)")
    return F.lit(1).cast("long") + F.call_function("div", parts, F.nullif(total + SMOOTH * terms, F.lit(0).cast("long")).cast("decimal(24,0)"))


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents with the term. A group without any term has a null one."""
    w = words(ascii_lower(F.col("text")), GAP)
    lists = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), w.alias("w"))
    # each text's words, and once more its different words: both are summed before anything is shuffled
    both = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("docs"), F.col("w").alias("w")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("docs"), F.array_distinct("w").alias("w")))
    each = lists.select(*GROUP, F.explode(both).alias("x")).select(*GROUP, "x.n", "x.docs", F.explode_outer("x.w").alias("term"))
    return each.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings(lang, source, term, n, lang_n) of kept terms, groups(lang, source, total, lang_total, terms))."""
    found = materialize(counts(docs))
    kept = found.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    kept = materialize(kept.select("lang", "term", "lang_n"))
    postings = materialize(found.select(*GROUP, "term", "n").join(kept, ["lang", "term"]))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = postings.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = found.select(*GROUP).distinct().join(F.broadcast(by_lang), "lang", "left").join(totals, GROUP, "left")
    groups = materialize(groups.select(*GROUP, *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms")]))
    discard(found, kept)
    return postings, groups


def _bucket(n: Column) -> Column:
    """Counts of one quarter of an octave, in whole numbers: small counts have a bucket each."""
    octave = F.length(F.bin(n)) - 1
    quarter = F.when(octave < 2, n).otherwise(F.expr("n div shiftleft(1L, length(bin(n)) - 3)"))
    return (octave * 8 + quarter).cast("int")


def _gain(n: Column, lang_n: Column) -> Column:
    return probability(n, F.col("total"), F.col("terms")) - probability(lang_n, F.col("lang_total"), F.col("terms"))


def overused(postings: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: each group's terms by how far their probability there is above the language's.

    A group's terms lie in buckets of like counts. A bucket's largest count and its least count in the language bound what
    any of its terms gains. Buckets are evaluated best bound first, a group's first ones until they hold `top` terms and
    then twice as many in each round, until the bounds of all unseen ones are below the value at rank `top`; those that
    equal it are evaluated, as terms tie by name. Only evaluated terms are shuffled and ranked.
    """
    held = materialize(postings.withColumn("bucket", _bucket(F.col("n"))))
    bounds = held.groupBy(*GROUP, "bucket").agg(F.max("n").alias("n"), F.min("lang_n").alias("lang_n"), F.count("*").alias("size"))
    bounds = bounds.join(small(groups), GROUP).withColumn("bound", _gain(F.col("n"), F.col("lang_n"))).filter("bound > 0")
    best = W.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket")
    before = F.sum("size").over(best.rowsBetween(W.unboundedPreceding, -1))
    bounds = materialize(bounds.select(*GROUP, "bucket", "bound", F.row_number().over(best).alias("place"), F.coalesce(before, F.lit(0)).alias("before")))
    ranked = W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    out, todo, upto = None, materialize(bounds.filter(F.col("before") < top)), None
    while not todo.isEmpty():
        seen = held.join(small(todo.select(*GROUP, "bucket")), [*GROUP, "bucket"]).join(small(groups), GROUP)
        found = seen.select(*GROUP, F.col("term").alias("item"), _gain(F.col("n"), F.col("lang_n")).alias("value")).filter("value > 0")
        found = found if out is None else found.unionByName(out.drop("rank"))
        last, out = out, materialize(found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))
        reached = todo.groupBy(*GROUP).agg(F.max("place").alias("done"))
        upto, old = materialize(reached if upto is None else reached.unionByName(upto).groupBy(*GROUP).agg(F.max("done").alias("done"))), upto
        kth = out.filter(F.col("rank") == top).select(*GROUP, F.col("value").alias("kth"))
        more = bounds.join(small(upto), GROUP).join(small(kth), GROUP, "left")
        more = more.filter((F.col("place") > F.col("done")) & (F.col("place") <= 2 * F.col("done")) & (F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))))
        discard(todo, last, old)
        todo = materialize(more.select(*bounds.columns))
    discard(todo, upto, bounds, held)
    if out is None:
        return groups.limit(0).select(*GROUP, F.lit("").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank"))
    return out.select(*GROUP, "item", "value", "rank")


def _meetings(postings: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """lang, one, other, met: what terms of both sources add to their distance beyond what each side gives by itself.

    Sources that share a term meet block by block, so a term of all sources is in no task as a whole.
    """
    at = postings.join(small(groups), GROUP)
    nothing = F.lit(0).cast("long")
    at = at.select("lang", "source", "term", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"), probability(nothing, F.col("total"), F.col("terms")).alias("base"))
    blocks = postings.groupBy("lang", "term").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    at = at.join(small(blocks), ["lang", "term"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    left = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = at.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    l, r = left.alias("l"), right.alias("r")
    same = (F.col("l.lang") == F.col("r.lang")) & (F.col("l.term") == F.col("r.term")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    met = l.join(r, same & (F.col("l.source") < F.col("r.source")))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    beyond = gap("l.p", "r.p") - gap("l.p", "r.base") - gap("l.base", "r.p") + gap("l.base", "r.base")
    return met.groupBy(F.col("l.lang").alias("lang"), F.col("l.source").alias("one"), F.col("r.source").alias("other")).agg(F.sum(beyond).alias("met"))


def distances(postings: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value, rank: each source's distance from each other one of its language, over all kept terms.

    A term that neither has adds the same for each pair of sources, and one that only one has adds what that one's count
    says, whoever the other is; so counts of equal counts give both, and postings only add what shared terms change.
    """
    nothing = F.lit(0).cast("long")
    zero = lambda c: F.coalesce(c, nothing)
    g = groups.withColumn("base", zero(probability(nothing, F.col("total"), F.col("terms"))))
    deal = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("deals"))
    one = g.join(F.broadcast(deal), "lang").withColumn("deal", F.pmod(F.xxhash64("source"), F.col("deals")).cast("int")).drop("deals")
    other = g.join(F.broadcast(deal), "lang").select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    pairs = materialize(one.join(other, ["lang", "deal"]).filter("source <> item").select(*GROUP, "item", "base", "item_base", "total", "terms"))
    equal = postings.groupBy(*GROUP, "n").agg(F.count("*").alias("times"))
    alone = pairs.join(equal, GROUP).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    change = F.col("times") * (F.abs(F.col("p") - F.col("item_base")) - F.abs(F.col("base") - F.col("item_base")))
    alone = materialize(alone.groupBy(*GROUP, "item").agg(F.sum(change).alias("alone")))
    met = materialize(_meetings(postings, groups, block))
    met = met.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "met").unionByName(met.select("lang", F.col("other").alias("source"), F.col("one").alias("item"), "met"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    key = [*GROUP, "item"]
    full = pairs.join(alone, key, "left").join(back, key, "left").join(met, key, "left")
    value = F.col("terms") * F.abs(F.col("base") - F.col("item_base")) + zero(F.col("alone")) + zero(F.col("back")) + zero(F.col("met"))
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return full.select(*key, value.alias("value")).withColumn("rank", rank)


def audit(docs: DataFrame, *, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` holds each source's distance from each other one of its language,
    part `term` the terms that it uses most beyond its language.

    Null texts, languages and sources are empty ones. A group without terms, or of a language that keeps none, has its
    pairs, all of value 0 where no term is kept, and no terms. Values tie by the bytes of the item. Repeated rows count as
    often as they stand there. Texts are taken whole, whatever their length, and an empty table gives no rows. Columns
    beside text, lang and source are not read, so their names can't clash. Counts are summed before they are shuffled, so a
    source or term that most rows have is no task's alone; rows of a source are gathered by count, not by document.
    """
    postings, groups = tables(docs)
    pair = distances(postings, groups, block).withColumn("part", F.lit("pair"))
    term = overused(postings, groups, top).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v))::BIGINT AS q
    FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""
