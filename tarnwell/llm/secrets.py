"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import table

#: Base patterns by kind, in the order of a digest; a match must be `least` long in group `group`.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharClass:
    """Candidates made of `alphabet` alone: windows of `size` characters are hot from `bits` of entropy on."""

    kind: str
    pattern: str
    alphabet: str
    size: int
    bits: float


DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
CLASSES = (
    CharClass("entropy_hex", r"^[0-9A-Fa-f]+$", DIGITS + "abcdefABCDEF", 20, 3.0),
    CharClass("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", DIGITS + LETTERS + LETTERS.upper() + "+/_=-", 20, 3.6),
)
#: Candidates that are no secrets whatever their entropy: no digit or no letter, UUIDs, paths, dashed or snake-case words,
#: alphabets in order, and keys that documentation uses.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^/?([A-Za-z0-9_-]{1,19}/){2,}[A-Za-z0-9_-]{0,19}$",
    r"^([A-Za-z]{1,19}|[0-9]{1,8})([_-]+([A-Za-z]{1,19}|[0-9]{1,8}))+$",
    r"0123456789|(?i)abcdefghij|EXAMPLE",
)
BLOCK = 256


def _offsets(lengths: Column) -> Column:
    """Sums of all lengths before each: in blocks, so that appending stays linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast("array<int>")
    within = lambda total, block: F.aggregate(block, F.struct(total.alias("t"), none.alias("a")), lambda s, x: F.struct((s["t"] + x).alias("t"), F.array_append(s["a"], s["t"]).alias("a")))
    add = lambda acc, block: F.element_at(F.transform(F.array(within(acc["t"], block)), lambda z: F.struct(z["t"].alias("t"), F.array_append(acc["l"], z["a"]).alias("l"))), 1)
    start = F.struct(F.lit(0).alias("t"), F.array().cast("array<array<int>>").alias("l"))
    return F.flatten(F.aggregate(blocks, start, add, lambda acc: acc["l"]))


NO_SPANS = "array<struct<start:int,stop:int,what:string>>"


def _matches(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, stop, what) of a pattern's leftmost non-overlapping matches, in code points; those with a group
    shorter than `least` are dropped. Texts without a match are only scanned once."""
    whole, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(w: Column, p: Column, g: Column) -> Column:
        lengths = F.transform(w, lambda x, i: F.length(x) + F.length(F.get(p, i)))
        ends = F.transform(F.arrays_zip(_offsets(lengths).alias("o"), w.alias("w"), F.slice(p, F.lit(1), F.size(w)).alias("p"), g.alias("g")), lambda x: F.struct((x["o"] + F.length(x["p"])).alias("start"), (x["o"] + F.length(x["p"]) + F.length(x["w"])).alias("stop"), x["w"].alias("what"), F.length(x["g"]).alias("n")))
        return F.transform(F.filter(ends, lambda x: x["n"] >= least), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["what"].alias("what")))

    # the three arrays are bound once, as fields of a lambda's variable
    once = F.element_at(F.transform(F.array(F.struct(whole.alias("w"), parts.alias("p"), part.alias("g"))), lambda m: placed(m["w"], m["p"], m["g"])), 1)
    return F.when(F.regexp_like(text, F.lit(pattern)), once).otherwise(F.array().cast(NO_SPANS))


def _hot(what: Column, c: CharClass) -> Column:
    """(first, last): where the first hot window begins and the last one ends, or first -1. For each character one count
    goes up and one goes down, and the window's sum of n log n with them; entropy is log size - sum / size."""
    table_ = F.array(*[F.lit(float(n * log2(n)) if n else 0.0) for n in range(c.size + 2)])
    codes = F.transform(F.filter(F.split(what, ""), lambda ch: ch != ""), lambda ch: F.position(ch, F.lit(c.alphabet)))
    zero = F.struct(F.array_repeat(F.lit(0), len(c.alphabet) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def run(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.when(i >= c.size, F.get(codes, i - c.size)).otherwise(F.lit(-1))
            n_old = F.get(acc["n"], old)
            less = F.when(old >= 0, F.get(table_, n_old - 1) - F.get(table_, n_old)).otherwise(F.lit(0.0))
            n_new = F.get(acc["n"], new) - F.when(old == new, F.lit(1)).otherwise(F.lit(0))
            s = acc["s"] + less + F.get(table_, n_new + 1) - F.get(table_, n_new)
            n = F.transform(acc["n"], lambda v, j: v + F.when(j == new, F.lit(1)).otherwise(F.lit(0)) - F.when(j == old, F.lit(1)).otherwise(F.lit(0)))
            hot = (i >= c.size - 1) & (F.lit(log2(c.size)) - s / c.size >= c.bits)
            first = F.when(hot & (acc["first"] < 0), i - (c.size - 1)).otherwise(acc["first"])
            return F.struct(n.alias("n"), s.alias("s"), first.alias("first"), F.when(hot, i + 1).otherwise(acc["last"]).alias("last"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.element_at(F.transform(F.array(codes), run), 1)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, one array of (start, stop, what) for each base kind, and `more`: (start, stop, kind) of high-entropy strings.

    Offsets count code points, stop is exclusive. A candidate belongs to the first class whose alphabet holds it all; its
    span runs from the first hot window to the last. Spans inside a base span of the same text are not added. Null and
    empty texts have no spans; repeated rows are scanned each; other columns are not looked at. Whole texts are scanned,
    in a time that grows with their length. Rows don't meet, so there is no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", *[_matches(F.col("text"), p, g, least).alias(kind) for kind, p, g, least in BASE], _matches(F.col("text"), CANDIDATE).alias("found"))
    base = F.concat(*[F.col(kind) for kind, *_ in BASE])
    plain = lambda x: F.forall(F.array(*map(F.lit, ALLOWED)), lambda p: ~F.regexp_like(x["what"], p))
    free = lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["stop"] <= b["stop"]))
    left = F.filter("found", lambda x: plain(x) & free(x))

    def spanned(x: Column, c: CharClass) -> Column:
        at = lambda h: F.struct((x["start"] + h["first"]).alias("start"), (x["start"] + h["last"]).alias("stop"), F.when(h["first"] >= 0, F.lit(c.kind)).alias("kind"))
        return F.element_at(F.transform(F.array(_hot(x["what"], c)), at), 1)

    def judged(x: Column) -> Column:
        out = F
        for c in CLASSES:
            out = out.when(F.regexp_like(x["what"], F.lit(c.pattern)), spanned(x, c))
        return out

    more = F.filter(F.transform(left, judged), lambda x: x["kind"].isNotNull())
    return d.select("doc_id", *[kind for kind, *_ in BASE], F.when(F.size("found") > 0, more).otherwise(F.array().cast("array<struct<start:int,stop:int,kind:string>>")).alias("more"))


def digest(*spans: Column) -> Column:
    """kind:start:end of (start, order, stop, kind) by start and then kind's order, comma-joined."""
    return F.array_join(F.transform(F.sort_array(F.concat(*spans)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    order = [kind for kind, *_ in BASE] + [c.kind for c in CLASSES]
    row = lambda x, kind, k: F.struct(x["start"].alias("start"), k.alias("k"), x["stop"].alias("stop"), kind.alias("kind"))
    of = lambda kind, k: F.transform(kind, lambda x: row(x, F.lit(kind), F.lit(k)))
    base = [of(kind, k) for k, kind in enumerate(order[: len(BASE)])]
    more = F.transform("more", lambda x: row(x, x["kind"], F.array_position(F.array(*map(F.lit, order)), x["kind"]).cast("int") - 1))
    return out.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(digest(*base), 256).alias("base_sha256"),
        digest(*base, more).alias("spans"),
    )
