"""Search by an index: which files hold the three-character pieces that a pattern can't match without."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import textsearch
from tarnwell.sources.segments import Segments
from tarnwell.sources.store import small, steps, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of lines whose trigrams are taken at once; longer lines are cut into overlapping parts.
CHUNK = 1 << 20
#: Pieces that one search asks for at most; a file must hold these, and its lines are matched in any case.
MOST_GRAMS = 60
#: Files up to which a search names them to the scan, so that it skips the others' pages; more are joined.
MOST_FILES = 1_000
#: Values of one list that is pushed to the scan as such.
PUSHED = 10
#: What the two dialects of regular expressions read differently: digits after a backslash, `\v`, quoting, sets in sets,
#: a set that begins with its end, and groups that set flags, name or comment.
DIFFERS = re.compile(r"\\[0-9vQE]|&&|\[\^?\]|\[[^\]]*\[|\(\?[^:=!<>]|\(\?<[^=!]")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Files and texts of lines, of about CHUNK characters together."""
    files, texts, size = [], [], 0
    for batch in batches:
        for file, text in zip(batch.column("file_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            for k in range(0, max(1, len(text) - 2), CHUNK):
                files.append(file), texts.append(text[k : k + CHUNK + 2])
                size += len(texts[-1])
                if size >= CHUNK:
                    yield files, texts
                    files, texts, size = [], [], 0
    if texts:
        yield files, texts


def _trigrams(files: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The distinct trigrams of each file's texts, A-Z in lower case and nothing else, by trigram and file."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return
    points += 32 * ((points >= ord("A")) & (points <= ord("Z")))
    seen = np.zeros(points.max() + 1, bool)
    seen[points] = True
    letters, (ids, of) = np.flatnonzero(seen), np.unique(np.array(files, np.int64), return_inverse=True)
    a, f = len(letters), len(ids)
    if a**3 * f >= 1 << 63:  # one file's always fit
        half = len(texts) // 2
        yield from _trigrams(files[:half], texts[:half])
        yield from _trigrams(files[half:], texts[half:])
        return
    place, row = (np.cumsum(seen) - 1)[points], np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    key = ((place[:-2] * a + place[1:-1]) * a + place[2:]) * f + of[row[:-2]]
    key = np.sort(key[row[:-2] == row[2:]])  # faster than np.unique, which hashes first
    code, file = np.divmod(key[np.diff(key, prepend=-1) > 0], f)
    first = np.diff(code, prepend=-1) > 0
    own = code[first]
    names = letters[np.stack((own // (a * a), own // a % a, own % a), 1)].astype("<u4").tobytes().decode("utf-32-le")
    gram = pa.DictionaryArray.from_arrays(pa.array(np.cumsum(first) - 1), pa.array([names[k : k + 3] for k in range(0, len(names), 3)], pa.string()))
    yield pa.RecordBatch.from_arrays([gram.cast(pa.string()), pa.array(ids[file])], ["gram", "file_id"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files, texts in _slices(batches):
        yield from _trigrams(files, texts)


def postings(lines: DataFrame) -> DataFrame:
    """gram, file_id: the trigrams of lines(file_id, text). Lines that come by file give each pair once, but for the few
    files that two tasks or two slices share; no shuffle gathers them."""
    return lines.filter("file_id IS NOT NULL").select("file_id", F.make_valid_utf8("text").alias("text")).mapInArrow(_postings, TABLES["grams"][0])


def _of_literal(text: str) -> tuple:
    text = text.translate(str.maketrans(UPPER, LOWER))
    return ("and", *dict.fromkeys(text[k : k + 3] for k in range(len(text) - 2)))


def _needs(items) -> tuple:
    """What a sequence of a parsed pattern needs: ("and" or "or", pieces and needs); ("and",) is nothing."""
    flat: list = []

    def unfold(seq) -> None:
        for op, arg in seq:
            if op is parser.SUBPATTERN:
                unfold(arg[-1])
            elif op is parser.ATOMIC_GROUP:
                unfold(arg)
            else:
                flat.append((op, arg))

    unfold(items)
    out, run = [], ""
    for op, arg in [*flat, (None, None)]:
        if op is parser.LITERAL:
            run += chr(arg)
        elif op is not parser.AT:  # a place has no width, so pieces go on across it
            out += _of_literal(run)[1:]
            run = ""
            if op is parser.BRANCH:
                ways = [_needs(way) for way in arg[1]]
                out += [("or", *ways)] if all(len(way) > 1 for way in ways) else []
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and arg[0] > 0:
                out += _needs(arg[2])[1:]
    return ("and", *dict.fromkeys(out))


def needed(query: str, regex: bool = False) -> tuple:
    """What a line (for a literal with line breaks: a file) must hold for the query to match, as a tree of ("and", ...) and
    ("or", ...) over trigrams in lower case. ("and",) if nothing can be told, as for patterns that only name sets, have flags
    other than a leading `(?i)`, or mean another thing to the engine that matches than to the one that reads them here."""
    if not regex:
        return ("and", *dict.fromkeys(g for part in query.split("\n") for g in _of_literal(part)[1:]))
    body = query.removeprefix("(?i)")
    if "\n" in query or DIFFERS.search(body):
        return ("and",)
    try:
        return _needs(parser.parse(body))
    except (re.error, RecursionError, OverflowError):
        return ("and",)


def _leaves(tree: tuple) -> list[str]:
    return list(dict.fromkeys(g for part in tree[1:] for g in ([part] if isinstance(part, str) else _leaves(part))))


def _asked(tree: tuple, most: int) -> tuple:
    """A tree of at most so many pieces that holds wherever the given one does: long ways ask for fewer of theirs. ("and",)
    if there are more ways than that."""

    def cut(tree: tuple, own: int) -> tuple:
        return (tree[0], *[p for p in tree[1:] if isinstance(p, str)][:own], *[cut(p, own) for p in tree[1:] if not isinstance(p, str)])

    own = most
    while own:
        less = cut(tree, own)
        if len(_leaves(less)) <= most:
            return less
        own //= 2
    return ("and",)


def _holds(tree: tuple, bits: dict[str, int], has: Column) -> Column:
    """Whether the bits of what a file has satisfy a tree."""
    parts = [_holds(p, bits, has) for p in tree[1:] if not isinstance(p, str)]
    own = [bits[p] for p in tree[1:] if isinstance(p, str)]
    if tree[0] == "and":
        mask = reduce(int.__or__, own, 0)
        return reduce(Column.__and__, parts, has.bitwiseAND(F.lit(mask).cast("long")) == mask)
    return reduce(Column.__or__, parts)


TABLES = {
    "files": ("file_id long", ["file_id"]),
    "lines": ("file_id long, line_no int, text string", ["file_id"]),
    "grams": ("gram string, file_id long", ["file_id"]),
}


class SearchIndex:
    """Lines and trigram postings at rest, kept by change.

    Lines lie by file, split by ranges. Postings (gram, file) are made where those lie and sorted by gram there, without a
    shuffle, so each of their parts has the grams of some files and a search reads the pages of the grams that it asks for
    from each, and of the files that may match. A batch writes the lines and
    postings of its files and ends those that they had; readers see whole batches. Null texts have no postings and match
    nothing; lines of under three characters are found by patterns that need no trigram, which read all lines.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.at = Segments(spark, path, TABLES, laid={"lines": ["file_id", "line_no"]}, within={"grams": ["gram", "file_id"]})

    def apply(self, lines: DataFrame | None, gone: DataFrame | None = None) -> int:
        """lines(file_id, line_no, text), whole files in place of what is known of them, and gone(file_id). The new version."""
        spark, n = self.at.spark, self.at.version() + 1
        self.at.clean(n)
        with steps(spark):
            fresh = spark.createDataFrame([], TABLES["lines"][0]) if lines is None else lines
            gone = spark.createDataFrame([], "file_id long") if gone is None else gone.select("file_id")
            before = self.at.live("files").select("file_id", "born")
            fresh = self.at.put(n, "lines", fresh)
            new = self.at.put(n, "files", fresh.select("file_id").distinct())
            ended = new.select("file_id").unionByName(gone).distinct()
            dead = written(before.join(small(ended), "file_id", "left_semi"))
            self.at.put(n, "grams", postings(fresh))
            for name in TABLES:
                self.at.put(n, name, None, dead)
            self.at.commit(n)
        return self.at.merge() if self.at.due() else n

    def candidates(self, query: str, regex: bool = False) -> DataFrame | None:
        """file_id of the files that hold what the query needs; None if it needs nothing that is indexed."""
        tree = _asked(needed(query, regex), MOST_GRAMS)
        asked = _leaves(tree)
        if not asked:
            return None
        bits = {g: 1 << k for k, g in enumerate(asked)}
        bit = F.element_at(F.create_map(*[F.lit(x) for g in asked for x in (g, bits[g])]), F.col("gram")).cast("long")
        postings = self.at.live("grams").filter(_among("gram", asked))
        has = postings.groupBy("file_id").agg(F.bit_or(bit).alias("has"))
        return has.filter(_holds(tree, bits, F.col("has"))).select("file_id")

    def lines_for(self, query: str, regex: bool = False) -> DataFrame:
        """All lines of the files that may match."""
        lines, found = self.at.live("lines").drop("born"), self.candidates(query, regex)
        if found is None:
            return lines
        ids = [r.file_id for r in found.limit(MOST_FILES + 1).collect()]  # bounded
        return lines.filter(_among("file_id", sorted(ids))) if len(ids) <= MOST_FILES else lines.join(small(found), "file_id", "left_semi")

    def search(self, files: DataFrame, query: str, *, regex: bool = False, **options) -> DataFrame:
        """What textsearch.search_code finds in all lines, read from those of the files that may match."""
        blank = not query.strip()
        return textsearch.search_code(self.at.live("lines").drop("born") if blank else self.lines_for(query, regex), files, query, regex=regex, **options)


def _among(column: str, values: Sequence) -> Column:
    """Membership as short lists, which the scan's statistics can use, joined two by two so the condition stays shallow."""
    parts = [F.col(column).isin(*values[k : k + PUSHED]) for k in range(0, len(values), PUSHED)] or [F.lit(False)]
    while len(parts) > 1:
        parts = [reduce(Column.__or__, parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0]
