"""Search by an index against the same search in all lines."""

import random
import re
import sys

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.operators import textsearch, trigrams
from tarnwell.sources.segments import Segments

TEXTS = {
    1: "def load(x):\n    return foobar(x)\n", 2: "FooBar\nk\n\nfoo bar", 3: "bazqux 12\nbazaar", 4: "straße İstanbul Kelvin 𝒳𝒴𝒵 end", 5: "x" * 50_000 + "needle" + "y" * 50_000, 6: "", 7: None, 8: "a.b*c [d] \\v abab", 9: "foobar\nfoobar",
}
PATTERNS = [
    "foobar", "(foobar|bazqux)", "(foo)(bar)", "foo ?bar", "(?i)FOOBAR", "(?i)foob(ar)+", "b[a]z", "(ab){2}", "baz(qux|aar)( 12)?", "foo(?=bar)", "(?:needle)y*$", "^def l.+d\\(", "𝒳𝒴𝒵", "[fF]oo[bB]ar", "foo|k", "x{9}needle", "\\Qfoo bar\\E",
    "(?s)foobar", "(?>foo)bar", "f(o|a)+bar", "stra\\u00dfe", "\\[d\\]", "[[d]]] ", "k$", "nowhere",
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, f"d/{k}.py", "python", t) for k, t in TEXTS.items()], "id long, path string, lang string, text string")
    lines = docs.select(F.col("id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return docs.drop("text"), lines.withColumn("line_no", F.col("line_no") + 1)


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    out = trigrams.SearchIndex(spark, str(tmp_path_factory.mktemp("search")))
    assert out.apply(tables[1]) == 1
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_same_rows_as_the_scan(index, tables):
    files, lines = tables
    for pattern in PATTERNS:
        want = rows(textsearch.search_code(lines, files, pattern, regex=True))
        assert rows(index.search(files, pattern, regex=True)) == want, pattern
        assert bool(want) != (pattern == "nowhere"), pattern
    for literal in ("foobar", "FooBar", "a.b*c", "k", "foobar\nfoobar", "İst", "𝒳𝒴", "\\v"):
        want = rows(textsearch.search_code(lines, files, literal, context=0))
        assert want and rows(index.search(files, literal)) == want, literal
    want = rows(textsearch.search_code(lines, files, "return", context=1))
    assert rows(index.search(files, "return", context=1)) == want
    assert rows(index.search(files, "  ")) == []


def test_only_files_that_may_match_are_read(index, tables):
    """The scan is told which files, and reads no others."""
    of = lambda p, **k: sorted(r.file_id for r in index.candidates(p, **k).collect())
    assert of("foobar") == [1, 2, 9] and of("needle") == [5] and of("(foobar|bazqux)", regex=True) == [1, 2, 3, 9] and of("nowhere") == []
    assert index.candidates("[a-z]+", regex=True) is None and index.candidates("ab") is None
    plan = index.lines_for("needle")._jdf.queryExecution().executedPlan().toString()
    assert "file_id,5)" in plan.split("PushedFilters")[1] and "Join" not in plan
    plan = index.candidates("foobar")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [bar,foo,oba,oob])" in plan.split("PushedFilters")[1]


def test_many_candidates_and_long_queries(index, tables, monkeypatch):
    files, lines = tables
    monkeypatch.setattr(trigrams, "MOST_FILES", 1)
    assert rows(index.search(files, "foobar")) == rows(textsearch.search_code(lines, files, "foobar"))
    monkeypatch.setattr(trigrams, "MOST_GRAMS", 2)
    assert len(trigrams._leaves(trigrams._asked(trigrams.needed("(foobar|bazqux)", True), 2))) == 2
    assert index.candidates("(foo|bar|baz)", regex=True) is None  # more ways than pieces
    for p in ("(foobar|bazqux)", "needle(y|z)", "(foo|bar|baz)"):
        assert rows(index.search(files, p, regex=True)) == rows(textsearch.search_code(lines, files, p, regex=True)) != []


def test_kept_by_change(spark, tables, tmp_path):
    """Batches of changed and gone files, a merge, and a batch that was cut off, against the lines as they are then."""
    files, lines = tables
    at = trigrams.SearchIndex(spark, str(tmp_path / "s"))
    frame = lambda given: spark.createDataFrame([(k, n + 1, t) for k, s in given.items() for n, t in enumerate(s.split("\n"))], "file_id long, line_no int, text string")
    now = {}
    for given, gone in (({1: "foobar", 2: "bazqux\nfoobar"}, []), ({2: "bazqux", 3: "foobar"}, [1]), ({4: "foobar"}, [3, 77]), ({}, [2])):
        at.apply(frame(given) if given else None, spark.createDataFrame([(g,) for g in gone], "file_id long") if gone else None)
        now = {k: s for k, s in (now | given).items() if k not in gone}
        for word in ("foobar", "bazqux"):
            assert sorted(r.file_id for r in at.candidates(word).collect()) == sorted(k for k, s in now.items() if word in s)
    at.at.put(at.at.version() + 1, "grams", spark.createDataFrame([("foo", 9)], TABLE_GRAMS))  # never committed
    assert [r.file_id for r in at.candidates("foobar").collect()] == [4]
    at.at.merge()
    assert [r.file_id for r in at.candidates("foobar").collect()] == [4] and {r.file_id for r in at.lines_for("x[yz]", regex=True).collect()} == {4}


TABLE_GRAMS = trigrams.TABLES["grams"][0]


def test_postings_are_not_shuffled(tables, spark, tmp_path, monkeypatch):
    """All trigrams of all lines are many times the lines: they are made and sorted where those lie."""
    plans, write = {}, Segments._write
    monkeypatch.setattr(Segments, "_write", lambda self, df, path: plans.update({path: df._jdf.queryExecution().executedPlan().toString()}) or write(self, df, path))
    trigrams.SearchIndex(spark, str(tmp_path / "s")).apply(tables[1])
    assert "Exchange" in plans["lines/rows-1"] and "Exchange" not in plans["grams/rows-1"] and "Sort [gram" in plans["grams/rows-1"]


def posted(rows):
    batch = pa.RecordBatch.from_pydict({"file_id": [f for f, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    out = [pair for b in trigrams._postings([batch, batch.slice(0, 0)]) for pair in zip(*(b.column(c).to_pylist() for c in ("gram", "file_id")))]
    return out, {(low[k : k + 3], f) for f, t in rows if t for low in [t.translate(str.maketrans(trigrams.UPPER, trigrams.LOWER))] for k in range(len(low) - 2)}


def test_postings_of_odd_lines(monkeypatch):
    rng = random.Random(3)
    rows = [(-5, None), (-5, ""), (0, "ab"), (0, "c\0\0\0\0"), (1 << 62, "𝒳𝒴𝒵 \U0010ffff É"), *((rng.randrange(6), "".join(rng.choice("aAbBzZ[@\0é𝒳 ") for _ in range(rng.randrange(40)))) for _ in range(300)), (7, "x" * 500 + "needle")]
    out, want = posted(rows)
    assert out == sorted(want)  # one slice: each once, in order
    monkeypatch.setattr(trigrams, "CHUNK", 64)
    out, want = posted(rows)
    assert set(out) == want and len(out) > len(want)
    assert posted([]) == ([], set()) == posted([(1, None), (2, "ab")])


def test_postings_of_more_letters_than_a_key_holds():
    letters = [*map(chr, range(0xD800)), *map(chr, range(0xE000, 0x100000))]
    rows = [(k, "".join(letters[k::12])) for k in range(12)]
    assert len(letters) ** 3 * 12 >= 1 << 63
    out, want = posted(rows)
    assert set(out) == want and len(out) == len(want)


def test_empty_index(spark, tables, tmp_path):
    at = trigrams.SearchIndex(spark, str(tmp_path / "s"))
    assert rows(at.search(tables[0], "foobar")) == []
    at.apply(None)
    assert rows(at.search(tables[0], "foobar")) == [] == rows(at.search(tables[0], "f+", regex=True))


def satisfied(tree, grams):
    ways = [p in grams if isinstance(p, str) else satisfied(p, grams) for p in tree[1:]]
    return all(ways) if tree[0] == "and" else any(ways)


ATOM = st.sampled_from(["a", "b", "abc", "AB", ".", "[ab]", "\\.", "a+", "b*", "(?:ab)?", "(?:abc|bca)", "(a|bc){2}", "c{2,3}", "$", "^"])


@pytest.mark.skipif(sys.version_info < (3, 11), reason="possessive repeats")
@settings(max_examples=300, deadline=None)
@given(st.lists(ATOM, min_size=1, max_size=6).map("".join), st.text("abcABC. ", max_size=30))
def test_what_matches_holds_what_is_needed(pattern, text):
    low = text.lower()
    grams = {low[k : k + 3] for k in range(len(low) - 2)}
    for flag, query in ((0, pattern), (re.I, f"(?i){pattern}")):
        if re.search(pattern, text, flag):
            assert satisfied(trigrams.needed(query, True), grams)
