"""Benchmark decontamination with a positional inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwell.llm.common import ascii_lower, materialize, row_key, small, table, words

#: What stands between words of this operator, which are of digits, lower-case letters and all beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Terms of a window whose lists are intersected before the rest of the phrase is compared.
RAREST = 2
#: Stands behind the last word of every text, so the index holds each text's length. No word contains it.
END = "\x01"


def windows(bench: DataFrame, *, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """phrase (terms joined by a space), len, items: each different window with the items that hold it.

    An item of fewer words, but not none, is one window. Null ids are left out of items; their windows count.
    """
    w = bench.select(F.col(id_col).cast("string").alias("item"), words(ascii_lower(F.col(text_col)), GAP).alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    w = w.select("item", F.explode(F.transform(at, lambda i: F.slice("w", i, F.lit(size)))).alias("w"))
    return w.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.first(F.size("w")).alias("len"), F.collect_set("item").alias("items"))


@dataclass
class Index:
    """docs(key, text): the texts. postings(key, doc_id, term, pos): places of the terms that some window is looked up by,
    and END at each text's length. anchors(phrase, len, term, off, bit, mask): those terms of each window."""

    docs: DataFrame
    postings: DataFrame
    anchors: DataFrame
    windows: DataFrame

    def _starts(self) -> DataFrame:
        """key, phrase, len, bit, mask, start: a posting list of an anchor, moved by its place in the window."""
        p, a = self.postings, small(self.anchors)
        return p.join(a, "term").select("key", "phrase", "len", "bit", "mask", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")

    def exact(self) -> DataFrame:
        """key, phrase, len, start of every occurrence of a window, once for repeated rows."""
        both = self._starts().groupBy("key", "phrase", "len", "start").agg(F.bit_or("bit").alias("seen"), F.first("mask").alias("mask")).filter("seen = mask")
        found = materialize(both.groupBy("key").agg(F.collect_list(F.struct("start", "len", "phrase")).alias("found")))
        texts = self.docs.join(small(found.select(F.col("key"))), "key", "left_semi").dropDuplicates(["key"])
        texts = texts.select("key", words(ascii_lower(F.col("text")), GAP).alias("w")).join(found, "key")
        same = F.filter("found", lambda x: F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ") == x["phrase"])
        return texts.select("key", F.explode(same).alias("x")).select("key", "x.phrase", "x.len", "x.start")

    def near(self, slop: int) -> DataFrame:
        """key, phrase, start, off_by: places where the rarest terms of a window stand in its order with up to `slop`
        words more or fewer between them (off_by 0: at their places)."""
        s = self._starts()
        one = F.col("bit") == 1
        lead = s.filter(one).select("key", "phrase", "start", "mask").distinct()
        rest = s.filter(~one).select("key", "phrase", F.col("start").alias("other"), "bit").distinct()
        pairs = lead.join(rest, ["key", "phrase"], "left").withColumn("off", F.abs(F.col("other") - F.col("start")))
        pairs = pairs.filter((F.col("mask") == 1) | (F.col("off") <= slop)).groupBy("key", "phrase", "start", "mask", "bit").agg(F.min("off").alias("off"))
        full = pairs.groupBy("key", "phrase", "start", "mask").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("seen"), F.coalesce(F.max("off"), F.lit(0)).alias("off_by"))
        return full.filter("seen + 1 = mask").select("key", "phrase", "start", "off_by")


def build_index(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = WINDOW, rarest: int = RAREST) -> Index:
    """Counts the benchmark's terms in all texts, picks each window's rarest, and stores where those stand.

    A window with a term that no text has can't occur and is left out. Frequencies are those of the texts at hand.
    """
    found = materialize(windows(bench, id_col=item_col, size=size))
    parts = found.select("phrase", "len", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = small(parts.select("term").distinct())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = words(ascii_lower(F.col("text")), GAP)
    freq = materialize(texts.select(F.explode(tokens).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")))
    known = parts.join(small(freq), "term")
    order = W.partitionBy("phrase").orderBy("n", "term", "off")
    all_known = F.count("*").over(W.partitionBy("phrase")) == F.col("len")
    anchors = known.withColumn("all", all_known).withColumn("rank", F.row_number().over(order)).filter(F.col("all") & (F.col("rank") <= rarest))
    bit = F.expr("cast(shiftleft(1, rank - 1) as int)")
    anchors = anchors.withColumn("bit", bit).withColumn("mask", F.sum("bit").over(W.partitionBy("phrase")).cast("int")).select("phrase", "len", "term", "off", "bit", "mask")
    anchors = materialize(anchors)
    wanted = small(anchors.select("term").union(docs.sparkSession.range(1).select(F.lit(END))).distinct())
    keyed = texts.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.concat(tokens, F.array(F.lit(END))).alias("w"))
    postings = keyed.select("key", "doc_id", F.posexplode("w").alias("pos", "term")).join(wanted, "term", "left_semi")
    postings = materialize(postings.select("key", "doc_id", "term", "pos"))
    return Index(texts.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text"), postings, anchors, found)


def contamination(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """key, doc_id, n_words, n_hit, items, contaminated: one row a document.

    A word is hit inside any occurrence of a window; a text is contaminated if a twentieth of its words are. Null and
    empty texts, and a benchmark without words, give no hits. Repeated rows each get their row. Columns other than id
    and text are not looked at. Postings are dealt by text and window, so neither a frequent term nor a hot source
    gathers in one task.
    """
    index = build_index(docs, bench, **options)
    hits = materialize(index.exact())
    place = F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
    by_doc = hits.groupBy("key").agg(F.size(F.array_distinct(place)).cast("long").alias("n_hit"))
    items = hits.select("key", "phrase").distinct().join(small(index.windows), "phrase").select("key", F.explode("items").alias("item"))
    items = items.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = index.postings.filter(F.col("term") == END).select("key", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(by_doc.join(items, "key", "left"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("key", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM_SQL = r"regexp_extract_all(" + LOWER_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERM_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {TERM_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, item, i, pos.n FROM pos JOIN win ON pos.phrase = win.phrase AND pos.n = win.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""
