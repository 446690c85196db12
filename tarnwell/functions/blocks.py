"""Code blocks: splitting a snippet, finding a definition, merging blocks into a file."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from tarnwell.functions.extract import definitions, facts

SEPARATOR = re.compile(r"^\s*[-=]{5,}\s*$", re.M)
CONSTANT = re.compile(r"^[A-Z_][A-Z0-9_]*$")
SUFFIXES = {"py": "python", "java": "java", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust"}


@dataclass(frozen=True)
class Block:
    kind: str  # function, class, import, constant or other
    name: str | None
    source: str


def language(path: str | None, hint: str | None = None) -> str:
    return hint or SUFFIXES.get((path or "").rsplit(".", 1)[-1].lower(), "python")


def parse_blocks(source: str, path: str | None = None, lang: str | None = None) -> list[Block]:
    """Top-level pieces of a snippet; lines of dashes or equals signs part it first."""
    parts = [p for p in SEPARATOR.split(source) if p.strip()]
    if len(parts) > 1:
        return [b for p in parts for b in parse_blocks(p, path, lang)]
    source = parts[0].strip("\n") if parts else ""
    if not source.strip():
        return []
    lang = language(path, lang)
    if lang == "python":
        try:
            return list(_python_blocks(source))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return [Block("other", None, source)]
    return list(_brace_blocks(source, lang))


def _python_blocks(source: str):
    lines = source.split("\n")
    for node in ast.parse(source).body:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
        text = "\n".join(lines[first - 1 : node.end_lineno])
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield Block("function", node.name, text)
        elif isinstance(node, ast.ClassDef):
            yield Block("class", node.name, text)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            yield Block("import", None, text)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(t := node.targets[0] if isinstance(node, ast.Assign) else node.target, ast.Name) and CONSTANT.match(t.id):
            yield Block("constant", t.id, text)
        else:
            yield Block("other", None, text)


def _brace_blocks(source: str, lang: str):
    rows = facts(source, lang)
    spans = sorted((r[3], -r[4], r[1], "class" if r[2] == "class" else "function") for r in rows if r[0] == "symbol")
    imports = {r[3] for r in rows if r[0] == "import"}
    lines, at, rest = source.split("\n"), 1, []

    def loose():
        text = "\n".join(rest).strip("\n")
        rest.clear()
        if text.strip():
            m = re.match(r"\s*(?:export\s+)?(?:const|let|var|static|final|public static final \w+)\s+([A-Z_][A-Z0-9_]*)\b", text)
            yield Block("constant", m[1], text) if m else Block("other", None, text)

    while at <= len(lines):
        span = next((s for s in spans if s[0] == at), None)
        if span:
            yield from loose()
            yield Block(span[3], span[2], "\n".join(lines[at - 1 : -span[1]]))
            at = -span[1] + 1
        elif at in imports:
            yield from loose()
            yield Block("import", None, lines[at - 1])
            at += 1
        else:
            if not lines[at - 1].strip():
                yield from loose()
            else:
                rest.append(lines[at - 1])
            at += 1
    yield from loose()


def find_bounds(code: str, name: str, kind: str, path: str | None = None, lang: str | None = None) -> tuple[int, int] | None:
    """[start, end) lines, 0-based, of the first definition of a name and kind."""
    lang = language(path, lang)
    kinds = ("class",) if kind == "class" else ("function", "method")
    found = sorted((r[3], r[4]) for r in definitions(code, lang) if r[1] == name and r[2] in kinds)
    if not found:
        return None
    start, end = found[0]
    if lang == "python":
        lines = code.split("\n")
        while start > 1 and lines[start - 2].lstrip().startswith("@"):
            start -= 1
    return start - 1, end


#: What stands before a defined name, and a line that sets a constant: names are compared apart, as a pattern for each name
#: costs more to compile than to run over its file.
HEADS = {"class": re.compile(r"(\s*)class\s+"), "function": re.compile(r"(\s*)(?:async\s+)?def\s+")}
EDGE = re.compile(r"\b")
SETS = re.compile(r"\s*(?:(?:export|const|let|var|static|final|pub)\s+)*([^\s:=]+)\s*(?::[^=]+)?=")


def _defines(line: str, name: str, kind: str) -> re.Match | None:
    m = HEADS["class" if kind == "class" else "function"].match(line) if name in line else None
    return m if m and line.startswith(name, m.end()) and EDGE.match(line, m.end() + len(name)) else None


def indented_bounds(lines: list[str], name: str, kind: str = "function", class_name: str | None = None) -> tuple[int, int] | None:
    """[start, end) of an indented definition, inside one class if that is named."""
    lo, hi = 0, len(lines)
    if class_name:
        outer = indented_bounds(lines, class_name, "class")
        if outer is None:
            return None
        lo, hi = outer[0] + 1, outer[1]
    for i in range(lo, hi):
        m = _defines(lines[i], name, kind)
        if m:
            end = next((j for j in range(i + 1, hi) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]) and not lines[j].lstrip().startswith((")", "]", "}"))), hi)
            while end > i + 1 and not lines[end - 1].strip():
                end -= 1
            while i > lo and lines[i - 1].startswith(f"{m[1]}@"):
                i -= 1
            return i, end
    return None


def constant_bounds(lines: list[str], name: str) -> tuple[int, int] | None:
    for i, x in enumerate(lines):
        if name in x and (m := SETS.match(x)) and m[1] == name:
            depth, end = 0, i
            for j in range(i, len(lines)):
                depth += sum(lines[j].count(c) for c in "([{") - sum(lines[j].count(c) for c in ")]}")
                end = j
                if depth <= 0:
                    break
            return i, end + 1
    return None


def class_context(source: str, target: str) -> str | None:
    """The class that holds a method of a name."""
    rows = definitions(source, "python")
    inner = next((r for r in rows if r[1] == target and r[2] == "function"), None)
    around = [r for r in rows if inner and r[2] == "class" and r[3] < inner[3] and inner[4] <= r[4]]
    return max(around, key=lambda r: r[3])[1] if around else None


IMPORT_LINE = re.compile(r"\s*(import\b|from\s+\S+\s+import\b|use\s|package\s|#include\b|const\s+.*require\()")


def import_section(lines: list[str]) -> tuple[int, int]:
    """[start, end) of the imports that lead a file, blank lines between and behind them included."""
    start = 0
    while start < len(lines) and (not lines[start].strip() or lines[start].lstrip().startswith(("#", "//"))) and not IMPORT_LINE.match(lines[start]):
        start += 1
    end = start
    while end < len(lines) and (IMPORT_LINE.match(lines[end]) or not lines[end].strip()):
        end += 1
    return (start, end) if end > start else (0, 0)


def merge_imports(lines: list[str], new: str) -> list[str]:
    """lines with the import lines that they lack, behind the last import."""
    have = {x.strip() for x in lines}
    add = [x for x in new.split("\n") if x.strip() and x.strip() not in have]
    start, end = import_section(lines)
    while end > start and not lines[end - 1].strip():
        end -= 1
    return lines[:end] + add + lines[end:]


def apply_blocks(original: str, blocks: list[Block], path: str | None = None, class_name: str | None = None) -> tuple[str, list[tuple[str, str | None, str]]]:
    """(text, [(kind, name, action)]): imports are merged, definitions replaced or appended, constants replaced or put behind
    the imports, the rest appended. With a class, functions are looked for in it and added at its end."""
    lines, done = original.split("\n"), []
    for b in blocks:
        new, bounds, action = b.source.split("\n"), None, "replaced"
        if b.kind == "import":
            merged = merge_imports(lines, b.source)
            action = "merged" if len(merged) > len(lines) else "unchanged"
            lines = merged
            done.append((b.kind, b.name, action))
            continue
        if b.kind in ("function", "class"):
            code = "\n".join(lines)
            if class_name and b.kind == "function" and language(path) == "python":
                bounds = indented_bounds(lines, b.name, "function", class_name)
                outer = indented_bounds(lines, class_name, "class")
                pad = "    " if outer else ""
                if outer and not new[0].startswith((" ", "\t")):
                    new = [pad + x if x.strip() else x for x in new]
                if bounds is None and outer:
                    lines[outer[1] : outer[1]] = ["", *new]
                    done.append((b.kind, b.name, "added to class"))
                    continue
            bounds = bounds or find_bounds(code, b.name, b.kind, path)
            if bounds and lines[bounds[0]][:1].isspace() and not new[0][:1].isspace():
                indent = re.match(r"\s*", lines[bounds[0]])[0]
                new = [indent + x if x.strip() else x for x in new]
        elif b.kind == "constant":
            bounds = constant_bounds(lines, b.name)
            if bounds is None:
                at = import_section(lines)[1]
                lines[at:at] = new
                done.append((b.kind, b.name, "added"))
                continue
        if bounds:
            lines[bounds[0] : bounds[1]] = new
        else:
            while lines and not lines[-1].strip():
                lines.pop()
            lines += ([""] if lines else []) + new + [""]
            action = "appended"
        done.append((b.kind, b.name, action))
    return "\n".join(lines), done


def apply_code(original: str, code: str, path: str | None = None) -> tuple[str, list[tuple[str, str | None, str]]]:
    """apply_blocks() of a snippet; a lone function that is a method in the file goes to its class."""
    blocks = parse_blocks(code, path)
    one = blocks[0].name if len(blocks) == 1 and blocks[0].kind == "function" else None
    return apply_blocks(original, blocks, path, class_context(original, one) if one and language(path) == "python" else None)
