"""Facts of source files: symbols, calls, imports, docstrings, names. Python by its own parser, other languages by pattern."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: One row a fact: what it is, its name and lines, and a text and number that depend on the kind.
FACT = "file_id long, fact string, name string, kind string, line_start int, line_end int, detail string, level int, flag boolean"


def _row(fact: str, name: str, start: int, end: int | None = None, kind: str | None = None, detail: str | None = None, level: int = 0, flag: bool = False) -> tuple:
    return fact, name, kind, start, end if end is not None else start, detail, level, flag


def _target(node: ast.expr) -> str | None:
    """The last part of what is called."""
    if isinstance(node, ast.Name):
        return node.id
    return node.attr if isinstance(node, ast.Attribute) else None


#: Errors in a source that are looked past at most; facts in a batch of rows.
ERRORS, FACTS = 20, 50_000


def parsed(source: str) -> tuple[ast.Module, list[tuple[int, str]]]:
    """(syntax tree of a Python source, errors as line and message). Of a source that doesn't parse the statements before
    the one with the error are taken; one that is nested too deeply for the parser has none."""
    errors: list[tuple[int, str]] = []
    while len(errors) < ERRORS:
        try:
            return ast.parse(source), errors
        except SyntaxError as e:
            errors.append((e.lineno or 1, e.msg))
            lines = source.split("\n")
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            # back to where the statement with the error begins, or its decorators
            while at > 0 and (not lines[at].strip() or lines[at][:1] in " \t)]}#" or lines[at - 1].startswith("@")):
                at -= 1
            source = "\n".join(lines[:at])
        except (ValueError, RecursionError, MemoryError) as e:
            errors.append((1, f"{type(e).__name__}: {e}"[:200]))
            break
    return ast.Module([], []), errors


def _unparse(node: ast.expr) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return "..."


#: Where statements hold others, in the order of their fields.
INNER = ("body", "handlers", "cases", "orelse", "finalbody")


def statements(tree: ast.Module) -> Iterator[ast.AST]:
    """What ast.walk() gives of a tree, in its order, without expressions: no definition is inside of one."""
    found: list[ast.AST] = [tree]
    for node in found:
        yield node
        for field in INNER:
            found.extend(getattr(node, field, ()))


def python_symbols(node: ast.AST) -> Iterator[tuple]:
    """The symbols that one node of a tree defines."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        yield _row("symbol", node.name, node.lineno, node.end_lineno, "class" if isinstance(node, ast.ClassDef) else "function")
    elif isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(node.value, ast.Lambda):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        yield from (_row("symbol", t.id, node.lineno, node.end_lineno, "function") for t in targets if isinstance(t, ast.Name))


def python_facts(source: str) -> Iterator[tuple]:
    """Facts of a Python source, and an `error` with line and message for each place that doesn't parse (the first is in the
    source as it is, the others in what stands before it)."""
    tree, errors = parsed(source)
    for line, message in errors[:1]:
        yield _row("error", "", line, detail=message)
    imports: set[int] = set()
    for node in ast.walk(tree):
        yield from python_symbols(node)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            text = ast.get_docstring(node)
            if text is not None:
                yield _row("docstring", node.name, node.lineno, node.end_lineno, kind, text)
            if node.decorator_list:
                yield _row("decorated", node.name, node.lineno)
            if kind == "function":
                every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
                for a in every:
                    if a.annotation is not None:
                        yield _row("hint", node.name, node.lineno, detail=f"{a.arg}\x01{_unparse(a.annotation)}")
                if node.returns is not None:
                    yield _row("hint", node.name, node.lineno, detail=f"\x01{_unparse(node.returns)}", flag=True)
        elif isinstance(node, ast.Call) and (name := _target(node.func)):
            yield _row("call", name, node.lineno, flag=isinstance(node.func, ast.Name))
        elif isinstance(node, ast.Import):
            imports.update(range(node.lineno, node.end_lineno + 1))
            for a in node.names:
                yield _row("import", a.name, node.lineno)
                yield _row("imported", a.asname or a.name.split(".")[0], node.lineno, detail=a.name)
        elif isinstance(node, ast.ImportFrom):
            imports.update(range(node.lineno, node.end_lineno + 1))
            star, module = any(a.name == "*" for a in node.names), node.module or ""
            yield _row("import", module, node.lineno, level=node.level, flag=star)
            for a in node.names:
                yield _row("imported", a.asname or a.name, node.lineno, detail=module, level=node.level, flag=star)
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            yield _row("name", node.id, node.lineno)
        elif isinstance(node, ast.Attribute):
            yield _row("name", node.attr, node.end_lineno)


WORD = r"[A-Za-z_$][\w$]*"
#: Patterns of definitions by language: (kind, pattern with the name in its first group).
DEFINITIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "javascript": (
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({WORD})"),
        ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({WORD})[^=]*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|{WORD}\s*=>)"),
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({WORD})"),
    ),
    "java": (
        ("class", rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+({WORD})"),
        ("function", rf"(?:^|[;{{])\s*(?:(?:public|private|protected|static|final)\s+)*[\w<>\[\], ]+\s({WORD})\s*=\s*(?:\([^()]*\)|{WORD})\s*->"),
        ("method", rf"(?:^|[;{{}}])\s*(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)*[\w<>\[\],.]+\s+({WORD})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\{{"),
    ),
    "go": (("function", rf"^func\s+({WORD})\s*[\(\[]"), ("method", rf"^func\s+\([^)]*\)\s*({WORD})\s*\("), ("class", rf"^type\s+({WORD})\s")),
    "rust": (
        ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+({WORD})"),
        ("function", rf"^\s*let\s+(?:mut\s+)?({WORD})[^=]*=\s*(?:move\s+)?\|"),
        ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+({WORD})"),
        ("class", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?({WORD})"),
    ),
}
DEFINITIONS["typescript"] = (*DEFINITIONS["javascript"], ("method", rf"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*({WORD})\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{=]+)?\{{"))
NOT_NAMES = frozenset("if for while switch catch return else new function do try throw await match loop fn super this typeof func go defer select".split())
IMPORTS: dict[str, tuple[str, ...]] = {
    "javascript": (r"""^\s*import\s+(?:[^'"]*?\sfrom\s+)?['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""),
    "java": (r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",),
    "rust": (r"^\s*(?:pub\s+)?use\s+([^;]+);",),
}
IMPORTS["typescript"] = IMPORTS["javascript"]


def _blank(source: str, lang: str) -> str:
    """The source with comments and strings blanked out, line by line as long as before."""
    quote = r"""'(?:\\.|[^'\\\n])'""" if lang == "rust" else r"""'(?:\\.|[^'\\\n])*'"""
    pattern = rf"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|{quote}|`(?:\\.|[^`\\])*`"""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _end(lines: list[str], at: int) -> int:
    """The line (0-based) on which the braces that open from line `at` close, or where its statement ends."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c in "{([":
                depth, opened = depth + 1, opened or c == "{"
            elif c in "})]":
                depth -= 1
                if depth <= 0 and opened and c == "}":
                    return i
            elif c == ";" and depth == 0 and not opened:
                return i
        if depth <= 0 and not opened and i > at:
            return at
    return at if not opened else len(lines) - 1


def brace_facts(source: str, lang: str) -> Iterator[tuple]:
    """Facts of a language with braces."""
    plain = _blank(source, lang)
    lines, raw = plain.split("\n"), source.split("\n")
    defined: set[tuple[int, str]] = set()
    for i, line in enumerate(lines):
        for kind, pattern in DEFINITIONS[lang]:
            for m in re.finditer(pattern, line):
                if m[1] not in NOT_NAMES and (i, m[1]) not in defined:
                    defined.add((i, m[1]))
                    yield _row("symbol", m[1], i + 1, _end(lines, i) + 1, kind)
                    if text := _comment_above(raw, i):
                        yield _row("docstring", m[1], i + 1, _end(lines, i) + 1, kind, text)
    inside = set()
    for lang_pattern in IMPORTS.get(lang, ()):
        for i, line in enumerate(raw):
            for m in re.finditer(lang_pattern, line):
                inside.add(i)
                module = m[1].strip()
                star = module.endswith("*") or bool(re.search(r"import\s+\*", line))
                yield _row("import", module.removesuffix(".*"), i + 1, flag=star)
                for name in _local_names(line, module, lang):
                    yield _row("imported", name, i + 1, detail=module.removesuffix(".*"), flag=module.endswith("*"))
    if lang == "go":
        for m in re.finditer(r'^import\s+(?:\(([^)]*)\)|[\w.]*\s*"[^"]+")', source, re.M):
            line = source.count("\n", 0, m.start()) + 1
            for p in re.finditer(r'([\w.]*)\s*"([^"]+)"', m[0]):
                inside.add(line - 1 + m[0].count("\n", 0, p.start()))
                yield _row("import", p[2], line + m[0].count("\n", 0, p.start()), flag=p[1] == ".")
                yield _row("imported", p[1] or p[2].rsplit("/", 1)[-1], line, detail=p[2], flag=p[1] == ".")
    for i, line in enumerate(lines):
        for m in re.finditer(rf"(\.\s*|::)?({WORD})\s*!?\s*\(", line):
            if m[2] not in NOT_NAMES and (i, m[2]) not in defined:
                yield _row("call", m[2], i + 1, flag=m[1] is None)
        if i not in inside:
            for m in re.finditer(WORD, line):
                if (i, m[0]) not in defined:
                    yield _row("name", m[0], i + 1)


def _comment_above(raw: list[str], at: int) -> str | None:
    """Text of the comment that ends right above a line."""
    i = at - 1
    while i >= 0 and raw[i].strip().startswith("@"):
        i -= 1
    if i >= 0 and raw[i].strip().endswith("*/"):
        j = i
        while j >= 0 and "/*" not in raw[j]:
            j -= 1
        return "\n".join(re.sub(r"^\s*(/\*+|\*(?!/))?\s?|\s*\*+/\s*$", "", x) for x in raw[max(j, 0) : i + 1]).strip() or None
    found = []
    while i >= 0 and re.match(r"\s*//", raw[i]):
        found.insert(0, re.sub(r"^\s*//[/!]?\s?", "", raw[i]))
        i -= 1
    return "\n".join(found) or None


def _local_names(line: str, module: str, lang: str) -> list[str]:
    if lang == "java":
        return [] if module.endswith("*") else [module.rsplit(".", 1)[-1]]
    if lang == "rust":
        names = re.findall(r"(\w+)\s*(?=[,}]|$)", module)
        return [n for n in names if n not in ("self", "crate")]
    m = re.search(r"import\s+(.*?)\s+from\s", line) or re.search(r"(?:const|let|var)\s+(.*?)\s*=\s*require", line)
    return re.findall(rf"({WORD})\s*(?=[,}}]|$)", m[1].strip()) if m else []


def facts(source: str, lang: str | None) -> list[tuple]:
    if lang == "python":
        return list(python_facts(source))
    return list(brace_facts(source, lang)) if lang in DEFINITIONS else []


@lru_cache(4)
def definitions(source: str, lang: str | None) -> tuple[tuple, ...]:
    """The symbols among the facts of a source, in their order. The last few sources are kept, as edits of one file ask for
    its definitions again and again."""
    if lang == "python":
        return tuple(r for node in statements(parsed(source)[0]) for r in python_symbols(node))
    return tuple(r for r in facts(source, lang) if r[0] == "symbol")


def extract(files: DataFrame) -> DataFrame:
    """files(id, lang, content) -> facts: each file is parsed once, by Arrow batches, and files don't meet. Facts go on as soon
    as there are FACTS of them, whatever the batch holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_id", "fact", "name", "kind", "line_start", "line_end", "detail", "level", "flag"]
        for pdf in batches:
            rows: list[tuple] = []
            for i, lang, text in zip(pdf.id, pdf.lang, pdf.content):
                rows += [(i, *r) for r in facts(text or "", lang)]
                if len(rows) >= FACTS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return files.select("id", "lang", "content").mapInPandas(run, FACT)


def raw_imports(source: str, lang: str) -> list[str]:
    """The import statements of a source as text."""
    if lang == "python":
        tree, _ = parsed(source)
        return [ast.get_source_segment(source, n) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    lines = {r[3] for r in facts(source, lang) if r[0] == "import"}
    return [x.strip() for i, x in enumerate(source.split("\n"), 1) if i in lines]
