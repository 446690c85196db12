"""Removal of long repeated strings with a logarithmic family of sampled suffix arrays."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import children, delete, discard, materialize, release, scratch_dir, small, table
from tarnwell.llm.hashing import mix, pieces, word_hashes

#: Bytes of a string that counts as repeated, and words of one that is reported besides (a passage of over 50 words).
LENGTH, WORDS = 400, 51
#: Batches that remove_repeats() deals a table into.
BATCHES = 4
#: Symbols handled at once; longer texts are cut into overlapping parts. A worker holds some 150 bytes for each of them.
CHUNK = 1 << 17
#: Rows of a batch that are Python objects at once.
ROWS = 500
_STEP = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(3).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = re.compile(r"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Measure:
    """What a text is a string of, how many symbols of it count as a long match, by how many of them suffixes are sampled,
    and how many neighbouring windows are compared at once where surroundings differ."""

    unit: str
    length: int
    gram: int
    block: int

    @property
    def kind(self) -> type:
        return np.uint8 if self.unit == "bytes" else np.uint64

    def symbols(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if self.unit == "bytes":
            yield from (np.frombuffer((text or "").encode(), np.uint8) for text in texts)
            return
        lo = size = 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK or k == len(texts) - 1:
                yield from word_symbols([t or "" for t in texts[lo : k + 1]])
                lo, size = k + 1, 0

    def values(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.unit == "bytes":
            return _BYTE[0][symbols], _BYTE[1][symbols]
        return tuple(mix(symbols + np.uint64(k)) | np.uint64(1) for k in _STEP)


def word_symbols(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words (runs of anything but ASCII white space, A-Z lower-cased). A text of over CHUNK characters
    is cut at white space, so that memory beside the result follows CHUNK."""
    if len(texts) > 1 and max(map(len, texts)) > CHUNK:
        return [x for t in texts for x in word_symbols([t])]
    if len(texts) > 1 or len(texts[0]) <= CHUNK:
        h, of = word_hashes(texts)
        return np.split(h, np.searchsorted(of, np.arange(1, len(texts))))
    parts, at = [], 0
    while at < len(texts[0]):
        gap = _SPACE.search(texts[0], at + CHUNK)
        stop = gap.start() if gap else len(texts[0])
        parts.append(word_hashes([texts[0][at:stop]])[0])
        at = stop
    return [np.concatenate(parts)]


def _powers(p: int, n: int) -> np.ndarray:
    out, m = np.ones(n, np.uint64), 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * np.uint64(pow(p, m, 1 << 64))
        m += k
    return out


class Rolling:
    """Two polynomial hashes modulo 2^64 of any stretch of an array of symbols, mixed into one."""

    def __init__(self, measure: Measure):
        self.measure, self.room = measure, 0

    def load(self, symbols: np.ndarray) -> Rolling:
        if len(symbols) > self.room:
            self.room = max(len(symbols), 2 * self.room)
            self.up = [_powers(p, self.room) for p in _STEP]
            self.down = [_powers(pow(p, -1, 1 << 64), self.room) for p in _STEP]
        self.sums = []
        for values, up in zip(self.measure.values(symbols), self.up):
            s = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(values * up[: len(symbols)], out=s[1:])
            self.sums.append(s)
        return self

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one, two = ((s[b] - s[a]) * d[a] for s, d in zip(self.sums, self.down))
        return mix(mix(one) + two * np.uint64(3))

    def grams(self, n: int) -> np.ndarray:
        """The hashes of all stretches of n symbols, by their start."""
        one, two = ((s[n:] - s[:-n]) * d[: len(s) - n] for s, d in zip(self.sums, self.down))
        return mix(mix(one) + two * np.uint64(3))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, m = len(x), -(-len(x) // w) * w
    p = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = x
    b = p.reshape(-1, w)
    low, high = np.minimum.accumulate(b, 1).ravel(), np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(high[: n - w + 1], low[w - 1 : n])


def stretches(roll: Rolling, symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups the windows of joined texts (ending at stops) by their sampled suffix.

    A window's sampled suffix starts at the smallest hash of `gram` symbols in it (the first, if there are several): equal
    windows have it at the same place. Returns for each run of windows with one sampled suffix: index of the text, first and
    last window start, the suffix's start, the hash of its first symbols, and a hash of all symbols of the run's windows.
    """
    m = roll.measure
    if len(symbols) < m.length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = roll.load(symbols)
    g = h.grams(m.gram)
    a = _sliding_min((g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64), m.length - m.gram + 1).astype(np.uint32)
    inside = np.ones(len(a) + 1, bool)  # windows that end in the text they start in
    for stop in stops.tolist():
        inside[max(0, stop - m.length + 1) : stop] = False
    inside[-1] = False
    new = np.ones(len(a) + 1, bool)
    np.not_equal(a[1:], a[:-1], out=new[1:-1])
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(inside & new)
    last = np.flatnonzero(inside[:-1] & (new[1:] | ~inside[1:]))
    suffix = a[first].astype(np.int64)
    whole = h(first, last + m.length) + mix((suffix - first).astype(np.uint64) * np.uint64(_STEP[0]) + ((last - first).astype(np.uint64) << np.uint64(32)))
    return np.searchsorted(stops, first, side="right"), first, last, suffix, g[suffix], mix(whole)


def _parts(symbols: Iterator[np.ndarray], length: int):
    """Joined texts of about CHUNK symbols: (symbols, stops, [(row, offset of the part)])."""
    buffer, owner, size = [], [], 0
    for row, text in enumerate(symbols):
        for base in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[base : base + CHUNK + length - 1]
            buffer.append(part), owner.append((row, base))
            size += len(part)
            if size >= CHUNK:
                yield np.concatenate(buffer), np.cumsum([len(b) for b in buffer]), owner
                buffer, owner, size = [], [], 0
    if buffer:
        yield np.concatenate(buffer), np.cumsum([len(b) for b in buffer]), owner


#: place packs unit (1 bit), lead and span (15 bits each) and first: the run's windows start at first..first + span, and its
#: suffix at first + lead. (gram, whole) are 128 bits that stand for the content of all windows of a run.
RUN = "k1 long, k2 int, place long, gram long, whole long"
unit_of, lead_of, span_of, first_of = (lambda p: p % 2), (lambda p: p // 2 % 32768), (lambda p: p // 65536 % 32768), (lambda p: p // (1 << 31))


def _unpacked(place: Column) -> dict[str, Column]:
    part = lambda shift, bits: F.shiftright(place, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return {"unit": part(0, 1), "lead": part(1, 15), "span": part(16, 15), "first": F.shiftright(place, 31)}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most, so that memory follows one of those."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The structs of an array of lists: which list each is of, and their fields. A null list has none."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = lists.flatten()
    return np.repeat(np.arange(len(lists)), size), {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(rows.type, rows.flatten())}


def _runs(measures: tuple[Measure, ...]):
    """The sampled suffixes of texts, as rows of RUN."""

    def run(batches):
        rolls = [Rolling(m) for m in measures]
        for batch in _slices(batches):
            k1, k2, texts = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), batch.column("text").to_pylist()
            for unit, roll in enumerate(rolls):
                for symbols, stops, owner in _parts(roll.measure.symbols(texts), roll.measure.length):
                    of, first, last, a, g, whole = stretches(roll, symbols, stops)
                    row, base = np.array(owner, np.int64).reshape(-1, 2).T
                    moved = first + (base - np.concatenate(([0], stops[:-1])))[of]
                    place = (moved << 31) | ((last - first) << 16) | ((a - first) << 1) | unit
                    yield pa.RecordBatch.from_pydict({"k1": k1[row[of]], "k2": k2[row[of]], "place": place, "gram": g.view(np.int64), "whole": whole.view(np.int64)})

    return run


ID = ["gram", "whole"]
#: Hashes are rarely the same, so that a file's dictionary of them would be made in vain.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in (*ID, "place")}


class Family:
    """A family of suffix arrays in levels, kept as tables in a folder that all executors reach.

    add() takes the sampled suffixes of a batch of texts, one entry for each content with the number of its places, and
    writes them sorted: the batch's array. A merge-scan against the levels (joins of sorted tables in which a key stands
    once on either side, so no group is gathered) finds long matches: contents that stand in both, and suffixes that begin
    alike with other surroundings. Those are marked. Copies within a batch are marked as it is built. Before a batch is
    added, levels at the end that hold equally many batches are merged into one: there are about log2(batches) levels,
    and an entry is written again as often. Places are not moved along: they stay in the batches' own tables.

    A family can be opened again by its path; a batch counts once its marks are written, and a level that a merged one
    covers doesn't count, so a build that was cut off anywhere goes on with the same batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        done = {n for n in children(spark, path) if children(spark, f"{path}/{n}", "_SUCCESS")}
        spans = [tuple(map(int, n.split("-")[1:])) for n in done if n.startswith("level-")]
        spans = sorted((s for s in spans if f"marks-{s[1]}" in done), key=lambda s: (s[0], -s[1]))
        self.levels: list[tuple[int, int]] = []  # first and last batch of each
        for lo, hi in spans:
            if not self.levels or lo > self.levels[-1][1]:
                self.levels.append((lo, hi))

    def _file(self, level: tuple[int, int]) -> str:
        return f"{self.path}/level-{level[0]}-{level[1]}"

    def _read(self, *levels: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("gram long, whole long, n long").parquet(*map(self._file, levels))

    def _write(self, entries: DataFrame, level: tuple[int, int]) -> DataFrame:
        entries.sortWithinPartitions(*ID).write.options(**PLAIN).mode("overwrite").parquet(self._file(level))
        return self._read(level)

    def entries(self) -> DataFrame:
        """gram, whole, n (number of places): each content of each level."""
        return self._read(*self.levels)

    def marks(self) -> DataFrame:
        """gram, whole: contents that stand in several places; with whole null, suffixes with several surroundings."""
        return self.spark.read.schema("gram long, whole long").parquet(*[f"{self.path}/{n}" for n in children(self.spark, self.path) if n.startswith("marks-")])

    def _merge(self) -> None:
        equal, size = [], 1  # levels at the end, each of which holds as many batches as all after it
        while self.levels and self.levels[-1][1] - self.levels[-1][0] + 1 == size:
            equal.append(self.levels.pop())
            size = equal[0][1] - equal[-1][0] + 1
        if len(equal) > 1:
            merged = (equal[-1][0], equal[0][1])
            self._write(self._read(*equal).groupBy(*ID).agg(F.sum("n").alias("n")), merged)
            delete(self.spark, *map(self._file, equal))
            equal = [merged]
        self.levels += equal

    def add(self, runs: DataFrame) -> None:
        self._merge()
        batch = self.levels[-1][1] + 1 if self.levels else 0
        new = self._write(runs.groupBy(*ID).agg(F.count("*").alias("n")), (batch, batch))
        ends = lambda df, lo, hi: df.groupBy("gram").agg(F.min("whole").alias(lo), F.max("whole").alias(hi))
        twice, around = new.filter("n > 1").select(*ID), ends(new, "lo", "hi")
        if self.levels:
            old = self.entries().select(*ID)
            twice = twice.unionByName(new.select(*ID).join(old.hint("merge"), ID))
            around = around.join(ends(old, "old_lo", "old_hi").hint("merge"), "gram", "left")
            around = around.select("gram", F.least("lo", "old_lo").alias("lo"), F.greatest("hi", "old_hi").alias("hi"))
        near = around.filter("lo <> hi").select("gram", F.lit(None).cast("long").alias("whole"))
        twice.unionByName(near).write.mode("overwrite").parquet(f"{self.path}/marks-{batch}")
        self.levels.append((batch, batch))
        release(self.spark)


def surroundings(runs: DataFrame, family: Family) -> DataFrame:
    """One place of each content of a suffix that has several: gram, whole, k1, k2, place."""
    several = small(family.marks().filter("whole is null").select("gram").distinct())
    # any of the places will do; first() keeps the columns of one row together and, unlike the least struct, needs no sort
    return runs.join(several, "gram", "left_semi").groupBy(*ID).agg(*[F.first(c).alias(c) for c in ("k1", "k2", "place")])


CUT = "gram long, whole long, unit int, lead int, data binary"


def _cut(measures: tuple[Measure, ...]):
    """The symbols of the runs that are to be compared window by window."""

    def run(batches):
        for batch, texts in pieces(_slices(batches), "text"):
            of, runs = _flat(batch.column("runs"))
            place = runs["place"]
            for unit, m in enumerate(measures):
                rows = np.flatnonzero(unit_of(place) == unit)
                if not len(rows):
                    continue
                own, which = np.unique(of[rows], return_inverse=True)
                whole = list(m.symbols([texts[k] for k in own.tolist()]))
                first = first_of(place[rows])
                last = first + span_of(place[rows]) + m.length
                data = [whole[k][x:y].tobytes() for k, x, y in zip(which.tolist(), first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_pydict({"gram": runs["gram"][rows], "whole": runs["whole"][rows], "unit": np.full(len(rows), unit, np.int32), "lead": lead_of(place[rows]).astype(np.int32), "data": pa.array(data, pa.binary())})

    return run


def _windows(measures: tuple[Measure, ...], batches):
    """For slices of CUT rows of one unit: (batch, rolling hash, place of each row's symbols, windows of each row, lead)."""
    rolls = [Rolling(m) for m in measures]
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        for u, roll in enumerate(rolls):
            rows = np.flatnonzero(unit == u)
            for k in range(0, len(rows), 250):
                part = batch.take(pa.array(rows[k : k + 250]))
                data = part.column("data").to_pylist()
                size = np.array([len(x) for x in data]) // np.dtype(roll.measure.kind).itemsize
                yield part, roll.load(np.frombuffer(b"".join(data), roll.measure.kind)), np.cumsum(size) - size, size - roll.measure.length + 1, part.column("lead").to_numpy().astype(np.int64)


def _blocks(measures: tuple[Measure, ...]):
    """Blocks of neighbouring windows: windows whose suffix stands block * no .. block * (no + 1) - 1 after their start. `core`
    stands for the symbols that all windows of such a block hold, `hull` for those of the windows that are there."""

    def run(batches):
        for part, roll, base, count, lead in _windows(measures, batches):
            m = roll.measure
            low, high = (lead - count + 1) // m.block, lead // m.block
            n = high - low + 1
            of = np.repeat(np.arange(len(n)), n)
            no = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of]
            at = base[of] + lead[of]  # where the suffix starts
            near, far = np.maximum(no * m.block, (lead - count + 1)[of]), np.minimum((no + 1) * m.block - 1, lead[of])
            mark = mix(no.astype(np.uint64) + np.uint64(_STEP[1]))
            core = roll(at - no * m.block, at + m.length - (no + 1) * m.block + 1)
            hull = roll(at - far, at - near + m.length) + mix((near * 65536 + far).astype(np.uint64))
            taken = pa.array(of)
            yield pa.RecordBatch.from_pydict({"gram": part.column("gram").take(taken), "whole": part.column("whole").take(taken), "lo": (lead[of] - far).astype(np.int32), "hi": (lead[of] - near).astype(np.int32), "core": mix(core + mark).view(np.int64), "hull": mix(hull).view(np.int64)})

    return run


def _prints(measures: tuple[Measure, ...]):
    """The windows lo..hi of each row's spans, with a hash of their symbols."""

    def run(batches):
        for part, roll, base, _, _ in _windows(measures, batches):
            row, spans = _flat(part.column("spans"))
            n = spans["hi"].astype(np.int64) - spans["lo"] + 1
            of = np.repeat(row, n)
            at = np.arange(n.sum()) + np.repeat(spans["lo"] - np.cumsum(n) + n, n)
            start = base[of] + at
            taken = pa.array(of)
            yield pa.RecordBatch.from_pydict({"gram": part.column("gram").take(taken), "whole": part.column("whole").take(taken), "at": at.astype(np.int32), "print": roll(start, start + roll.measure.length).view(np.int64)})

    return run


def _of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of keys(k1, k2): where those are few, other texts are set aside before the join that deals texts out."""
    return texts.join(small(keys.select("k1", "k2")), ["k1", "k2"], "left_semi")


def _shared_windows(texts: DataFrame, runs: DataFrame, family: Family, measures: tuple[Measure, ...]) -> DataFrame:
    """gram, whole, lo, hi: the first and the last window of contents with differing surroundings that stand elsewhere too.
    All windows of a content hold its suffix, so they overlap: what such windows cover is one stretch, from lo on.

    One copy of each content is cut out of its text. Blocks of windows are compared first: a block that stands elsewhere
    as a whole is settled, one that shares its core with other blocks is compared window by window, and others are alone.
    All counts are of hashes, summed before the shuffle, so that a place with any number of surroundings is spread out.
    Sides in which a key stands once are joined by hash, so that neither side is sorted. Tables and shuffles of a step are
    let go of before the next but one, as the disk is fullest here.
    """
    spark = texts.sparkSession
    lists = materialize(surroundings(runs, family).groupBy("k1", "k2").agg(F.collect_list(F.struct(*ID, "place")).alias("runs")))
    # repeated rows are all cut: what they count for too much stands in several places in truth
    cut = materialize(_of(texts, lists).join(lists.hint("shuffle_hash"), ["k1", "k2"]).select("text", "runs").mapInArrow(_cut(measures), CUT))
    discard(lists)
    release(spark)
    blocks = cut.mapInArrow(_blocks(measures), "gram long, whole long, lo int, hi int, core long, hull long")
    hulls = materialize(blocks.groupBy("core", "hull").agg(F.count("*").alias("n"), *[F.first(c).alias(f"one_{c}") for c in ID]))
    release(spark)
    apart = hulls.groupBy("core").agg(F.min("hull").alias("lo"), F.max("hull").alias("hi")).filter("lo <> hi").select("core", F.lit(True).alias("apart"))
    state = hulls.join(apart.hint("shuffle_hash"), "core", "left").filter("n > 1 or apart").withColumnRenamed("core", "c").withColumnRenamed("hull", "h")
    told = materialize(blocks.join(state.hint("shuffle_hash"), (F.col("core") == F.col("c")) & (F.col("hull") == F.col("h"))).select(*ID, "lo", "hi", (F.col("n") > 1).alias("twice"), (F.col("apart") & ((F.col("n") == 1) | ((F.col("gram") == F.col("one_gram")) & (F.col("whole") == F.col("one_whole"))))).alias("apart")))
    discard(hulls)
    release(spark)
    spans = told.filter("apart").groupBy(*ID).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    prints = materialize(cut.join(spans.hint("shuffle_hash"), ID).mapInArrow(_prints(measures), "gram long, whole long, at int, print long"))
    discard(cut)
    release(spark)
    often = prints.groupBy("gram", "print").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "print")
    single = prints.join(often.hint("shuffle_hash"), ["gram", "print"]).select(*ID, F.col("at").alias("lo"), F.col("at").alias("hi"))
    both = told.filter("twice").select(*ID, "lo", "hi").unionByName(single)
    out = materialize(both.groupBy(*ID).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    discard(told, prints)
    return out


def _joined(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same spans by row and place, joined where they touch."""
    order = np.lexsort((lo, row))
    row, lo, hi = (x[order].astype(np.int64) for x in (row, lo, hi))
    far = np.maximum.accumulate(hi + (row << 40))  # a row's spans end before the next row's begin
    new = np.append(True, lo[1:] + (row[1:] << 40) > far[:-1])[: len(row)]
    return row[new], lo[new], (far - (row << 40))[np.append(new[1:], True)[: len(row)]]


def _strip(batches, kept: bool = True):
    for batch in _slices(batches):
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        of, cuts = _flat(batch.column("cuts"))
        parts = [cuts["unit"] == unit for unit in (0, 1)]
        (row, lo, hi), (of_words, lo_words, hi_words) = (_joined(of[x], cuts["lo"][x], cuts["hi"][x]) for x in parts)
        n_spans = np.bincount(row, minlength=len(texts))
        ends = np.cumsum(n_spans).tolist()
        lo, hi, rest = lo.tolist(), hi.tolist(), []
        for raw, n, k in zip(texts, n_spans.tolist(), ends):
            rest.append(b"".join([raw[x:y] for x, y in zip([0, *hi[k - n : k]], [*lo[k - n : k], len(raw)])]))
        size, left = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (texts, rest))
        words = np.zeros(len(texts), np.int64)
        np.add.at(words, of_words, hi_words - lo_words)
        out = {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_removed": size - left, "n_spans": n_spans, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in rest], "repeated_words": words}
        yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(rest, pa.binary())} if kept else {}))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, text: keys of 96 bits, which only repeated rows share; null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("k1"), F.hash(text, F.lit(1)).alias("k2"), text.alias("text"))


def sampled(texts: DataFrame, measures: tuple[Measure, ...]) -> DataFrame:
    """k1, k2, place, gram, whole: the sampled suffixes of keyed texts."""
    return texts.select("k1", "k2", "text").mapInArrow(_runs(measures), RUN)


#: A content at over this part of all places is looked up by a broadcast (so there are at most as many as 1 / HOT, of 16
#: bytes), as its places would all meet in one task of a shuffle.
HOT = 1e-5


def cuts(texts: DataFrame, runs: DataFrame, family: Family, measures: tuple[Measure, ...]) -> DataFrame:
    """k1, k2, cuts (array of unit, lo, hi): what is covered by strings that the family has found elsewhere too. A span of
    a run is told once, however many rows repeat."""
    shared = _shared_windows(texts, runs, family, measures)
    release(texts.sparkSession)
    least = HOT * len(family.levels) * runs.count()
    hot = materialize(family.entries().filter((F.col("n") > 1) & (F.col("n") > least)).select(*ID).distinct())
    twice = family.marks().filter("whole is not null").distinct().join(F.broadcast(hot), ID, "left_anti")
    none = F.lit(None).cast("int")
    found = twice.select(*ID, none.alias("lo"), none.alias("hi")).unionByName(shared)
    whole = F.max(F.col("lo").isNull())
    found = found.groupBy(*ID).agg(F.when(~whole, F.min("lo")).alias("lo"), F.when(~whole, F.max("hi")).alias("hi"))
    # unit, lo and hi are one number until they are put into a text's list: sets of numbers are made faster than of structs
    span = F.expr("shiftleft(first + lo, 18) + shiftleft(hi - lo, 1) + unit").alias("c")
    placed = lambda df, lo, hi: df.select("k1", "k2", lo.alias("lo"), hi.alias("hi"), *[c.alias(n) for n, c in _unpacked(F.col("place")).items()])
    often = placed(runs.join(F.broadcast(hot), ID, "left_semi"), none, none)
    rest = placed(runs.join(F.broadcast(hot), ID, "left_anti").join(found.hint("shuffle_hash"), ID), F.col("lo"), F.col("hi"))
    each = lambda df: df.select("k1", "k2", "first", "unit", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", "span").alias("hi")).select("k1", "k2", span)
    length = lambda unit: F.when(unit == 0, measures[0].length).otherwise(measures[1].length)
    lo, unit = (lambda c: F.shiftright(c, 18)), (lambda c: c.bitwiseAND(F.lit(1)).cast("int"))
    whole_span = lambda c: F.struct(unit(c).alias("unit"), lo(c).alias("lo"), (lo(c) + F.shiftright(c, 1).bitwiseAND(F.lit((1 << 17) - 1)) + length(unit(c))).alias("hi"))
    out = materialize(each(often).unionByName(each(rest)).groupBy("k1", "k2").agg(F.transform(F.collect_set("c"), whole_span).alias("cuts")))
    discard(shared, hot)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = 64, block: int = 16, words: int = WORDS, word_gram: int = 8, batches: int = BATCHES, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated_words, kept (binary): texts without the bytes covered by a
    string of `length` bytes that starts anywhere else too. repeated_words counts words inside strings of `words` words
    that start anywhere else too; nothing is removed for them.

    Texts are dealt into `batches` by their key and go through a Family of suffix arrays one batch after the other; the
    result doesn't depend on their number. The arrays are sampled: of all suffixes those at minimizers stand for the
    windows around them, one in about 170 bytes. A content that stands in several places is repeated as a whole; where one
    sampled suffix has different surroundings, those are compared by blocks of windows and then by windows. Contents are
    told by 128 bits of hashes.

    Null and empty texts lose nothing and have 0 in all counts. Repeated rows are copies of each other, so they lose all
    covered bytes alike; ties can't arise. Texts below `length` bytes are kept whole; texts of any length are handled in
    overlapping parts. An empty table gives no rows. Cuts follow bytes, so `kept` may end inside a character. Other columns
    are not looked at, so their names can't clash. Without `kept`, that column is not there and what is left is only hashed;
    texts that lose nothing don't go through Python.
    """
    measures = (Measure("bytes", length, gram, block), Measure("words", words, word_gram, max(1, block // 2)))
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col)
    dealt = sampled(texts, measures).withColumn("batch", F.pmod("k2", F.lit(batches)))
    path = f"{scratch_dir(spark)}/family-{uuid.uuid4().hex}"
    dealt.write.options(**PLAIN).partitionBy("batch").parquet(f"{path}/runs")
    runs = spark.read.schema(dealt.schema).parquet(f"{path}/runs")
    family = Family(spark, f"{path}/levels")
    for k in range(batches):
        family.add(runs.filter(F.col("batch") == k).drop("batch"))
    found = cuts(texts, runs.drop("batch"), family, measures)
    delete(spark, path)
    release(spark)
    kind = texts.schema["doc_id"].dataType.simpleString()
    keys = small(found.select("k1", "k2"))
    cut = texts.join(keys, ["k1", "k2"], "left_semi").join(found.hint("shuffle_hash"), ["k1", "k2"]).select("doc_id", "text", "cuts")
    stripped = cut.mapInArrow(lambda batches: _strip(batches, kept), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated_words long" + ", kept binary" * kept)
    raw, none = F.col("text").cast("binary"), F.lit(0).cast("long")
    whole = {"n_bytes": F.octet_length("text").cast("long"), "n_removed": none, "n_spans": none, "kept_sha256": F.sha2(raw, 256), "repeated_words": none} | ({"kept": raw} if kept else {})
    return stripped.unionByName(texts.join(keys, ["k1", "k2"], "left_anti").select("doc_id", *[c.alias(n) for n, c in whole.items()]))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), kept=False)
