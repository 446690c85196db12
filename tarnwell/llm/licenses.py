"""License scan: a positional index of licences by their rarest words, and verified key phrases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import ascii_lower, table, words

#: What stands between words of this operator, which are of digits, letters and all beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words by which a licence's phrases may stand farther from or nearer to each other than in its text.
SLOP = 6
#: Phrases that give a label wherever they stand.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Licence texts and notices; brackets hold the key phrases, all of which must be there.
TEXTS = (
    ("mit-notice", "[released under the mit license]"),
    ("mit-notice", "[licensed under the mit license]"),
    ("mit-text", "[permission is hereby granted] [free of charge] [to any person obtaining a copy] of this software and associated documentation files"),
    ("apache-2.0", "licensed under the [apache license] [version 2 0]"),
    ("apache-2.0-text", "[you may not use this file except in compliance with the license] you may obtain a copy of the license at"),
    ("gpl-2.0", "gnu [general public license] [version 2]"),
    ("gpl-3.0", "gnu [general public license] [version 3]"),
    ("gpl-text", "this program is free software you can [redistribute it and or modify it] [under the terms of the gnu] general public license as published by the [free software foundation]"),
    ("lgpl", "gnu [lesser general public license]"),
    ("agpl", "gnu [affero general public license]"),
    ("bsd-text", "[redistribution and use in source and binary forms] [with or without modification] are permitted provided that the [following conditions are met]"),
    ("isc-text", "[permission to use copy modify] and or distribute this software [for any purpose with or without fee] is hereby granted"),
    ("mpl-2.0", "this source code form is [subject to the terms of the mozilla public license] v 2 0"),
    ("mpl-2.0", "[mozilla public license] [version 2 0]"),
    ("epl-2.0", "[eclipse public license] [v 2 0]"),
    ("unlicense", "this is [free and unencumbered software] [released into the public domain]"),
    ("zlib-text", "this software is [provided as is] [without any express or implied warranty] in no event will the authors be held liable"),
    ("warranty-disclaimer", "the software is [provided as is] [without warranty of any kind]"),
    ("cc0-1.0", "[cc0 1 0] universal"),
    ("cc-by-4.0", "[cc by 4 0]"),
    ("cc-by-sa-4.0", "[cc by sa 4 0]"),
    ("cc-by-nc-4.0", "[cc by nc 4 0]"),
    ("cc-by-nd-4.0", "[cc by nd 4 0]"),
    ("cc-by-nc-sa-4.0", "[cc by nc sa 4 0]"),
    ("cc-by-nc-nd-4.0", "[cc by nc nd 4 0]"),
    ("all-rights-reserved", "[all rights reserved]"),
)
#: What a base label and a licence's verified text each leave of the doubt that a text is licensed.
MENTION, VERIFIED = 0.5, 0.1


@dataclass(frozen=True)
class Phrase:
    """A key phrase: place within its licence's text, in words, and whether it is a base one."""

    licence: int
    label: str
    base: bool
    number: int
    of: int
    offset: int
    words: tuple[str, ...]


def phrases(base=BASE, texts=TEXTS) -> list[Phrase]:
    out = [Phrase(k, label, True, 0, 1, 0, tuple(text.split())) for k, (label, text) in enumerate(base)]
    for k, (label, text) in enumerate(texts, len(base)):
        keys, at, opened = [], 0, None
        for word in text.split():
            opened = at if word.startswith("[") else opened
            at += 1
            if word.endswith("]"):
                keys.append((opened, tuple(text.replace("[", "").replace("]", "").split()[opened:at])))
        out += [Phrase(k, label, False, j, len(keys), offset, w) for j, (offset, w) in enumerate(keys)]
    return out


def document_counts(docs: DataFrame, terms: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many texts each term is, over all of them; one number a term reaches the driver."""
    has = F.array_intersect(words(ascii_lower(F.col(text_col)), GAP), F.array(*map(F.lit, terms)))
    return {r["term"]: r["n"] for r in docs.select(F.explode(has).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}


@dataclass(frozen=True)
class Index:
    """Postings of licences: each phrase under its rarest word, with that word's place in it. A licence is looked up by
    `lead`, the rarest of all its words; frequencies are those of the texts at hand."""

    postings: tuple[tuple[str, int, Phrase], ...]
    leads: tuple[str, ...]


def build_index(counts: dict[str, int], found: list[Phrase]) -> Index:
    """The index of phrases; a licence with a word that no text has can't occur and is left out."""
    rarity = lambda word: (counts.get(word, 0), word)
    every = {p.licence: sorted({w for q in found if q.licence == p.licence for w in q.words}, key=rarity) for p in found}
    live = {k: w for k, w in every.items() if all(counts.get(x, 0) for x in w)}
    anchors = [(min(p.words, key=rarity), p) for p in found if p.licence in live]
    return Index(tuple((a, p.words.index(a), p) for a, p in anchors), tuple(sorted({w[0] for w in live.values()})))


HIT = "array<struct<licence:int,number:int,of:int,base:boolean,label:string,start:int,relative:int>>"


def _hits(index: Index) -> Column:
    """Verified places of phrases in w: where an anchor stands, the phrases that hang on it are compared word by word."""
    if not index.postings:
        return F.array().cast(HIT)
    by_word: dict[str, list[tuple[int, Phrase]]] = {}
    for anchor, at, p in index.postings:
        by_word.setdefault(anchor, []).append((at, p))
    anchors = F.array(*map(F.lit, sorted(by_word)))

    def verified(anchor: str, i: Column) -> Column:
        """The phrases of an anchor at place i of w, as an array."""
        each = []
        for at, p in by_word[anchor]:
            here = F.when(i >= at, F.array_join(F.slice("w", F.greatest(i - at + 1, F.lit(1)), F.lit(len(p.words))), " ") == " ".join(p.words)).otherwise(F.lit(False))
            hit = F.struct(F.lit(p.licence).alias("licence"), F.lit(p.number).alias("number"), F.lit(p.of).alias("of"), F.lit(p.base).alias("base"), F.lit(p.label).alias("label"), (i - at).alias("start"), (i - at - p.offset).alias("relative"))
            each.append(F.when(here, hit))
        return F.array_compact(F.array(*each)).cast(HIT)

    def at(i: Column) -> Column:
        out = F
        for anchor in sorted(by_word):
            out = out.when(F.get("w", i) == anchor, verified(anchor, i))
        return out.otherwise(F.array().cast(HIT))

    sites = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(anchors, x), i)), lambda i: i.isNotNull())
    lookup = F.size(F.array_intersect("w", F.array(*map(F.lit, index.leads)))) > 0
    return F.when(lookup, F.flatten(F.transform(sites, at))).otherwise(F.array().cast(HIT))


def _agrees(hits: Column, slop: int) -> Column:
    """Whether hits of one licence, ordered by the start of the text that they speak for, have all of its phrases within
    `slop` words: one walk that keeps each phrase's last start."""
    of = F.get(hits, F.lit(0))["of"]
    start = F.struct(F.array_repeat(F.lit(None).cast("int"), of).alias("last"), F.lit(False).alias("met"))

    def step(acc: Column, h: Column) -> Column:
        last = F.transform(acc["last"], lambda x, k: F.when(k == h["number"], h["relative"]).otherwise(x))
        return F.struct(last.alias("last"), (acc["met"] | F.forall(last, lambda x: F.coalesce(x >= h["relative"] - slop, F.lit(False)))).alias("met"))

    return F.aggregate(hits, start, step, lambda acc: acc["met"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base=BASE, texts=TEXTS, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, places, base_labels, labels, score, one row a row of docs: places(label, start) of base phrases,
    labels of those and of the licences whose key phrases all stand in the text at their relative places, give or take
    `slop` words.

    Words are counted over all texts first. Each licence is looked up by the rarest of its words, then each phrase by its
    own rarest word; starts that the phrases speak for are intersected, and phrases are compared word by word, so nothing
    is lost by the lookup. All of it is within a row: no text is shuffled, and a hot source or repeated rows don't matter.
    Only numbers for the licences' own words, of which `texts` bounds the number, reach the driver.

    Null and empty texts have no words, no labels and score 0; an empty table gives no rows. Very long texts are read whole
    and walked once. Ties in rarity go by the word. Columns beside id and text are not read, so their names can't clash.
    The score is 1 less what doubt is left: half of it by a base label, a tenth by a verified licence.
    """
    found = phrases(base, texts)
    counts = document_counts(docs, sorted({w for p in found for w in p.words}), text_col)
    index = build_index(counts, found)
    rows = docs.select(F.col(id_col).alias("doc_id"), words(ascii_lower(F.col(text_col)), GAP).alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), _hits(index).alias("hits"))
    own = F.array_distinct(F.transform(F.filter("hits", lambda h: ~h["base"]), lambda h: h["licence"]))
    of = lambda k: F.array_sort(F.filter("hits", lambda h: h["licence"] == k), lambda a, b: F.when(a["relative"] < b["relative"], -1).when(a["relative"] > b["relative"], 1).otherwise(F.lit(0)))
    verified = F.transform(F.filter(F.transform(own, of), lambda hits: _agrees(hits, slop)), lambda hits: F.get(hits, F.lit(0))["label"])
    places = F.transform(F.filter("hits", lambda h: h["base"]), lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start")))
    rows = rows.select("doc_id", "n_words", places.alias("places"), F.array_distinct(verified).alias("verified"))
    rows = rows.withColumn("base_labels", F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))))
    doubt = F.pow(F.lit(MENTION), F.size("base_labels")) * F.pow(F.lit(VERIFIED), F.size("verified"))
    return rows.select("doc_id", "n_words", "places", "base_labels", F.array_sort(F.array_union("base_labels", "verified")).alias("labels"), F.round(1 - doubt, 6).alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _values() -> str:
    rows = [f"({p.licence}, '{p.label}', {str(p.base).lower()}, {p.number}, {p.of}, {p.offset}, {list(p.words)!r})" for p in phrases()]
    return ",\n".join(rows)


SQL = rf"""
WITH p(licence, label, base, number, of_, at_, words) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, i - 1 AS i, w[i] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
h AS (SELECT rid, licence, label, base, number, of_, i AS start, i - at_ AS rel FROM t JOIN p ON t.word = p.words[1] JOIN d USING (rid) WHERE d.w[i + 1:i + len(p.words)] = p.words),
b AS (SELECT rid, count(*) AS n, min(start) AS lo, max(start) AS hi, count(DISTINCT label) AS k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h WHERE base GROUP BY rid),
o AS (SELECT DISTINCT rid, label FROM (SELECT x.rid, x.label, x.of_, x.licence, x.start, x.rel, count(DISTINCT y.number) AS met
    FROM h x JOIN h y ON x.rid = y.rid AND x.licence = y.licence AND y.rel BETWEEN x.rel AND x.rel + {SLOP} WHERE NOT x.base GROUP BY ALL) WHERE met = of_),
n AS (SELECT rid, count(*) AS k FROM o GROUP BY rid),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM o UNION ALL SELECT rid, label FROM h WHERE base) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
    round(1 - pow({MENTION}, coalesce(b.k, 0)) * pow({VERIFIED}, coalesce(n.k, 0)), 6) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN n USING (rid)
"""
