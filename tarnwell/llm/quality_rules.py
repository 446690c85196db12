"""Quality rules: a decision list learned by sequential covering, applied as one conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import materialize, row_key, table, words

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Conditions of a rule, rules of a list, rows that a rule must cover, and its least precision.
MAX_TERMS, MAX_RULES, MIN_COVER, MIN_PRECISION = 3, 8, 20, 0.8
BINS = 256


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text.

    Windows of three words are compared by 64-bit hashes within one text; only texts with a repeated window sort them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(F.col(text_col)).alias("w"))
    spaced = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    d = d.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        spaced.alias("lines"),
        F.when(F.size("w") >= 3, F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")).alias("tri"),
    )
    rest = ("key", "doc_id", "n_words", "word_chars", "n_symbols")
    d = d.select(*rest, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "tri")
    rest = (*rest, "n_lines", "n_dup_lines")
    again = F.size(F.array_distinct("tri")) < F.size("tri")
    d = d.select(*rest, F.when(again, F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    twin = lambda x, j: (x["h"] == F.get("s", j - 1)["h"]) | (x["h"] == F.get("s", j + 1)["h"])
    at = F.filter(F.transform("s", lambda x, j: F.when(twin(x, j), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    return d.select(*rest, F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Whole numbers from 0 to 255 for each statistic: conditions are thresholds on them."""
    part = lambda a, b, scale: F.when(F.col(b) > 0, F.floor(F.col(a) * scale / F.col(b))).otherwise(0)
    cut = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(BINS - 1)).cast("int")
    return {
        "words": cut(F.floor(F.log2(F.col("n_words") + 1) * 8)),
        "word_length": cut(part("word_chars", "n_words", 8)),
        "symbols": cut(part("n_symbols", "word_chars", 1024)),
        "dup_lines": cut(part("n_dup_lines", "n_lines", 255)),
        "repeats": cut(part("n_repeat_words", "n_words", 255)),
    }


@dataclass(frozen=True)
class Rule:
    """All of terms (feature, at least or below, bin) hold: the text is rejected."""

    terms: tuple[tuple[str, str, int], ...]

    def condition(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, at in self.terms:
            out = out & (of[name] >= at if sign == ">=" else of[name] < at)
        return out


def decision(rules: list[Rule], of: dict[str, Column]) -> Column:
    """0 where no rule holds, else the number of the first that does: one ordered conditional expression."""
    out = F
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.condition(of), F.lit(k))
    return F.lit(0) if not rules else out.otherwise(F.lit(0))


def _counts(train: DataFrame, names: list[str]) -> dict:
    """(fold, feature) -> for each bin, rows to reject and rows to keep. At most 2 x features x BINS rows reach the driver."""
    long = train.select("fold", "bad", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names])).alias("x"))
    rows = long.groupBy("fold", "x.name", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    out = {(f, n): [[0] * BINS, [0] * BINS] for f in (0, 1) for n in names}
    for r in rows:
        out[r["fold"], r["name"]][0][r["bin"]] += r["p"]
        out[r["fold"], r["name"]][1][r["bin"]] += r["n"]
    return out


def _best(counts: dict, names: list[str], p0: int, n0: int) -> tuple | None:
    """The term with the highest information gain over (p0, n0) on the growing rows."""
    from math import log2

    before, best = log2(p0 / (p0 + n0)), None
    for name in names:
        p, n = counts[0, name]
        for at in range(1, BINS):
            if not (p[at] or n[at] or p[at - 1] or n[at - 1]):
                continue
            for sign, a, b in ((">=", sum(p[at:]), sum(n[at:])), ("<", sum(p[:at]), sum(n[:at]))):
                if a >= MIN_COVER and (b < n0 or a < p0) and (gain := a * (log2(a / (a + b)) - before)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, (name, sign, at), a, b
    return best


def learn(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_terms: int = MAX_TERMS, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Sequential covering over all labelled rows that pass the base rules; label 0 is what rules are to cover.

    Two thirds of the rows grow a rule, one third prunes it: a rule gains the term of the highest information gain
    while it covers rows of label 1, then loses last terms while that raises (p - n) / (p + n) on the pruning rows. A
    rule is kept if it is precise enough there; the rows that it covers are set aside, and the next is grown. Each step is
    one aggregation to counts by bin. Without labelled rows of both kinds there are no rules.
    """
    of, names = features(), list(features())
    lab = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    fold = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, 1).otherwise(0)
    train = stats.filter(~base_failed()).join(lab, F.col("doc_id") == F.col("l_id"))
    train = materialize(train.select(fold.alias("fold"), (1 - F.col("label")).alias("bad"), *[c.alias(n) for n, c in of.items()]))
    cols = {n: F.col(n) for n in names}
    rules: list[Rule] = []
    left = train
    while len(rules) < max_rules:
        terms: list[tuple] = []
        now = left
        counts = _counts(now, names)
        p0, n0 = (sum(counts[0, names[0]][k]) for k in (0, 1))
        hold = []  # (p, n) on the pruning rows after each term
        while p0 and n0 and len(terms) < max_terms and (found := _best(counts, names, p0, n0)):
            _, term, p0, n0 = found
            terms.append(term)
            now = now.filter(Rule((term,)).condition(cols))
            counts = _counts(now, names)
            hold.append(tuple(sum(counts[1, names[0]][k]) for k in (0, 1)))
        if not terms:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in hold]
        keep = max(range(len(terms)), key=lambda k: (worth[k], -k)) + 1
        p, n = hold[keep - 1]
        if not p or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple(terms[:keep])))
        left = left.filter(~rules[-1].condition(cols))
    return rules


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """text_stats() of all rows with base_failed, rule (the first that holds, 0: none) and kept.

    Null and empty texts have no words, so the base rule rejects them. Rows with a null id are judged like others, and
    never teach. Repeated rows are judged each. Labels other than 0 and 1 don't count.
    """
    stats = materialize(text_stats(docs, id_col, text_col))
    rules = learn(stats, labels, **options)
    rule = decision(rules, features())
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
