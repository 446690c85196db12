"""Text operations: edit distance, fuzzy replacement, diffs, signatures."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.blocks import apply_code

#: Bounds of the fuzzy matchers.
MIDDLE_SIMILARITY, SIZE_SLACK, SAME_LINES = 0.65, 0.25, 0.5
#: A sliding match must be this similar, and better than the next by this much.
THRESHOLD, AMBIGUITY = 0.85, 0.05


def levenshtein_rank(rows: DataFrame, column: str, target: str, limit: int = 10) -> DataFrame:
    """The rows nearest to a text by edit distance."""
    return rows.withColumn("distance", F.levenshtein(F.col(column), F.lit(target))).orderBy("distance", column).limit(limit)


def signature(lines: Column) -> Column:
    """Of a definition's lines (an array): the Python `def` up to the line that ends with a colon. Other languages: empty."""
    first = F.lit(1)
    ends = F.transform(lines, lambda x, i: F.when(F.endswith(F.rtrim(F.regexp_replace(x, r"\s+#.*$", "")), F.lit(":")), i + 1))
    end = F.array_min(ends)
    starts = F.regexp_like(F.ltrim(F.get(lines, F.lit(0))), F.lit(r"^(async\s+)?(def|class)\s"))
    return F.when(starts & end.isNotNull(), F.array_join(F.slice(lines, first, end), "\n")).otherwise(F.lit(""))


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Exact replacement of the first occurrence; null where there is none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def lines_changed(diff: Column) -> Column:
    return F.size(F.filter(F.split(diff, "\n"), lambda x: F.regexp_like(x, F.lit(r"^(\+(?!\+\+)|-(?!--))"))))


# --- matchers: each yields the stretches of a content that stand for a text to find ------------------------------------


def _windows(content: str, size: int) -> Iterator[tuple[str, list[str]]]:
    """Every run of `size` lines, as text and as lines."""
    lines = content.split("\n")
    for i in range(len(lines) - size + 1):
        part = lines[i : i + size]
        yield "\n".join(part), part


def _by_lines(same: Callable[[list[str]], object]) -> Callable[[str, str], Iterator[str]]:
    """A matcher of line windows whose form equals that of the text to find."""

    def match(content: str, find: str) -> Iterator[str]:
        want = find.split("\n")
        if want and want[-1] == "":
            want = want[:-1]
        form = same(want)
        yield from (text for text, part in _windows(content, len(want)) if want and same(part) == form)

    return match


def exact(content: str, find: str) -> Iterator[str]:
    if find in content:
        yield find


def _common_indent(lines: list[str]) -> list[str]:
    full = [x for x in lines if x.strip()]
    cut = min((len(x) - len(x.lstrip()) for x in full), default=0)
    return [x[cut:] if x.strip() else "" for x in lines] if full else lines


line_trimmed = _by_lines(lambda lines: [x.strip() for x in lines])
indentation_flexible = _by_lines(_common_indent)


def whitespace_normalized(content: str, find: str) -> Iterator[str]:
    want = " ".join(find.split())
    yield from (x for x in content.split("\n") if " ".join(x.split()) == want)
    size = len(find.split("\n"))
    if size > 1:
        yield from (text for text, _ in _windows(content, size) if " ".join(text.split()) == want)


def _similarity(a: str, b: str) -> float:
    """1 for equal texts, 0 for two empty ones, which tell nothing."""
    longest = max(len(a), len(b))
    return 0.0 if not longest else 1 - edit_distance(a, b) / longest


def edit_distance(a: str, b: str) -> int:
    if a == b or not a or not b:
        return 0 if a == b else len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _anchored(content: str, find: str) -> Iterator[tuple[list[str], list[str]]]:
    """(lines of a stretch, lines to find) where the first and last lines agree but for blanks."""
    want = find.rstrip("\n").split("\n")
    if len(want) < 3:
        return
    lines = content.split("\n")
    head, tail = want[0].strip(), want[-1].strip()
    for i, x in enumerate(lines):
        if x.strip() == head:
            end = next((j for j in range(i + 2, len(lines)) if lines[j].strip() == tail), None)
            if end is not None:
                yield lines[i : end + 1], want


def block_anchor(content: str, find: str) -> Iterator[str]:
    best, score = None, MIDDLE_SIMILARITY
    for part, want in _anchored(content, find):
        if abs(len(part) - len(want)) > max(1, int(len(want) * SIZE_SLACK)):
            continue
        pairs, alike = list(zip(part[1:-1], want[1:-1])), 0.0
        for a, b in pairs:  # no further than to the bound: what is similar enough is not ranked
            alike += _similarity(a.strip(), b.strip()) / len(pairs)
            if alike >= MIDDLE_SIMILARITY:
                break
        alike = alike if pairs else 1.0
        if alike >= score and (best is None or alike > score):
            best, score = "\n".join(part), alike
    if best is not None:
        yield best


def context_aware(content: str, find: str) -> Iterator[str]:
    for part, want in _anchored(content, find):
        if len(part) == len(want):
            pairs = [(a.strip(), b.strip()) for a, b in zip(part[1:-1], want[1:-1]) if a.strip() or b.strip()]
            if not pairs or sum(a == b for a, b in pairs) >= SAME_LINES * len(pairs):
                yield "\n".join(part)


def escape_normalized(content: str, find: str) -> Iterator[str]:
    plain = find.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r").replace("\\\\", "\\")
    if plain in content:
        yield plain
    unescaped = lambda x: x.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r").replace("\\\\", "\\")
    yield from (text for text, _ in _windows(content, len(plain.split("\n"))) if text != plain and unescaped(text) == plain)


def trimmed_boundary(content: str, find: str) -> Iterator[str]:
    core = find.strip()
    if core and core != find and core in content:
        yield core


def multi_occurrence(content: str, find: str) -> Iterator[str]:
    yield from [find] * content.count(find)


MATCHERS = (exact, line_trimmed, block_anchor, whitespace_normalized, indentation_flexible, escape_normalized, trimmed_boundary, context_aware, multi_occurrence)


def disproportionate(found: str, wanted: str) -> bool:
    """Whether a match is far longer than the text to find: in lines, and for several lines in characters too."""
    n, size = len(wanted.split("\n")), len(wanted.strip())
    return len(found.split("\n")) >= max(n + 3, 2 * n) or (n > 1 and len(found.strip()) > max(size + 500, 4 * size))


def fuzzy_replace(content: str, old: str, new: str, replace_all: bool = False) -> tuple[str | None, str | None]:
    """(result, error): the first matcher with one hit decides; with replace_all all hits of the first that has any."""
    if old == new:
        return None, "old and new text are the same"
    if not old:
        return None, "the text to replace is empty"
    several = False
    for matcher in MATCHERS:
        for found in matcher(content, old):
            if not found:
                continue
            if disproportionate(found, old):
                return None, "the match is much longer than the text to replace"
            if replace_all:
                return content.replace(found, new), None
            if content.count(found) == 1:
                return content.replace(found, new), None
            several = True
    return None, "the text to replace occurs more than once" if several else "the text to replace was not found"


def best_match(wanted: str, content: str, threshold: float = THRESHOLD) -> tuple[int, int, float] | None:
    """(first line, last line, similarity) of the line window most like a text; none below the threshold or without a
    clear lead over the windows that don't overlap it."""
    size, scored = len(wanted.split("\n")), []
    for i, (text, _) in enumerate(_windows(content, size)):
        scored.append((difflib.SequenceMatcher(None, wanted, text, autojunk=False).ratio(), i))
    if not scored or max(scored)[0] < threshold:
        return None
    top, at = max(scored, key=lambda x: (x[0], -x[1]))
    rest = max((s for s, i in scored if abs(i - at) >= size), default=0.0)
    return None if top - rest < AMBIGUITY else (at, at + size - 1, top)


def unified_diff(old: str, new: str, path: str = "file") -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))


PREVIEW = "new_content string, diff string, lines_changed int, error string"


def preview_edits(rows: DataFrame, mode: str = "fuzzy", replace_all: bool = False) -> DataFrame:
    """rows(path, content, old_code, new_code) with preview(new_content, diff, lines_changed, error): Arrow batches, no shuffle."""
    if mode not in ("fuzzy", "ast"):
        raise ValueError("mode is fuzzy or ast")

    @F.pandas_udf(PREVIEW)
    def preview(path: pd.Series, content: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
        out = []
        for p, c, o, n in zip(path, content, old, new):
            c, o, n = ((x or "").replace("\r\n", "\n") for x in (c, o, n))
            result, error = fuzzy_replace(c, o, n, replace_all) if mode == "fuzzy" else (apply_code(c, n, p)[0], None)
            diff = unified_diff(c, result, p) if result is not None else None
            changed = sum(1 for x in (diff or "").split("\n") if x[:1] in "+-" and x[:3] not in ("+++", "---") and x)
            out.append((result, diff, changed, error))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PREVIEW.split(", ")])

    return rows.withColumn("preview", preview("path", "content", "old_code", "new_code"))


def edit_rows(previews: DataFrame) -> DataFrame:
    """Pending rows of the edits table: ids from the content, so reruns agree."""
    ok = previews.filter("preview.error is null")
    ident = F.md5(F.concat_ws("\x01", "path", "old_code", "new_code"))
    return ok.select(ident.alias("id"), F.col("path").alias("file_path"), "old_code", "new_code", F.col("preview.diff").alias("diff"), F.lit(False).alias("applied"), F.unix_timestamp().cast("double").alias("created_at"), F.lit(None).cast("double").alias("applied_at"))


def latest_edits(edits: DataFrame) -> DataFrame:
    """The state of each edit: the row that was applied, else the newest."""
    row = F.struct(*edits.columns)
    return edits.groupBy("id").agg(F.max_by(row, F.struct("applied", F.coalesce("applied_at", "created_at"))).alias("r")).select("r.*")


def legacy_preview(rows: DataFrame) -> DataFrame:
    """rows(content, old_code, new_code) with new_content: the first exact occurrence replaced, natively."""
    return rows.withColumn("new_content", replace_first(F.col("content"), F.col("old_code"), F.col("new_code")))
