"""Extraction and the index of small sources, with answers worked out by hand."""

import pytest

from tarnwell.functions import blocks, extract
from tarnwell.operators import audit, deps, graph, symbols, textsearch
from tarnwell.plans.index import CodeIndex
from tarnwell.sources import ingest, scan, tree

HELLO = "def hello_world():\n    print('Hello World')\n\nclass MyClass:\n    def method(self):\n        pass\n"
PAYMENT = "def validate_card():\n    return True\n\ndef charge_customer():\n    validate_card()\n    return 'success'\n"


def found(source, lang, fact="symbol"):
    return {(r[1], r[2]) for r in extract.facts(source, lang) if r[0] == fact}


def test_python_symbols():
    rows = [(r[1], r[2], r[3], r[4]) for r in extract.facts(HELLO, "python") if r[0] == "symbol"]
    assert sorted(rows) == [("MyClass", "class", 4, 6), ("hello_world", "function", 1, 2), ("method", "function", 5, 6)]
    assert found("square = lambda x: x * x\ngreet = lambda n: n\ndef normal_func():\n    pass\n", "python") == {("square", "function"), ("greet", "function"), ("normal_func", "function")}
    assert {r[0] for r in extract.facts("def broken(:", "python")} == {"error"} and extract.facts("x", None) == []


def test_brace_symbols():
    js = "const add = (a, b) => a + b;\nconst greet = function(n) { return n; };\nconst multiply = x => x;\nfunction* idGen() { yield 1; }\nconst countUp = function*() { yield 1; };\nfunction namedFunc() {\n  return 1;\n}\n"
    assert {n for n, k in found(js, "javascript")} == {"add", "greet", "multiply", "idGen", "countUp", "namedFunc"}
    ts = "const double = (n: number): number => n * 2;\nconst greetTs = function(n: string) { return n; };\nfunction* tsGen() { yield 1; }\nfunction namedTs() { return 1; }\n"
    assert {n for n, k in found(ts, "typescript") if k == "function"} == {"double", "greetTs", "tsGen", "namedTs"}
    java = "class MyService {\n    Runnable task = () -> System.out.println();\n    Comparator<String> cmp = (a, b) -> a.compareTo(b);\n    void normalMethod() {\n    }\n}\n"
    assert found(java, "java") == {("MyService", "class"), ("task", "function"), ("cmp", "function"), ("normalMethod", "method")}
    rust = "fn named_fn() -> i32 { 42 }\nfn main() {\n    let add = |a, b| a + b;\n    let square = |x| x * x;\n}\n"
    assert found(rust, "rust") == {(n, "function") for n in ("named_fn", "main", "add", "square")}
    go = 'package main\nimport (\n  "fmt"\n  str "strings"\n)\ntype T struct {}\nfunc (t T) M() {}\nfunc F() { fmt.Println(str.ToUpper("a")) }\n'
    assert found(go, "go") == {("T", "class"), ("M", "method"), ("F", "function")}
    assert {r[1] for r in extract.facts(go, "go") if r[0] == "import"} == {"fmt", "strings"}


def test_imports_and_docs():
    rows = [(r[1], r[6], r[7]) for r in extract.facts("from ..x import y\nimport a, b\nfrom m import *\n", "python") if r[0] == "import"]
    assert sorted(rows) == [("a", 0, False), ("b", 0, False), ("m", 0, True), ("x", 2, False)]
    docs = [(r[1], r[5], r[3], r[4]) for r in extract.facts('def hello():\n    """Say hello."""\n    pass\n\nclass Foo:\n    """A foo class."""\n    pass\n', "python") if r[0] == "docstring"]
    assert sorted(docs) == [("Foo", "A foo class.", 5, 7), ("hello", "Say hello.", 1, 3)]
    assert extract.raw_imports("import a\nx = 1\nfrom b import c\n", "python") == ["import a", "from b import c"]
    assert extract.raw_imports("import a.b.C;\nclass X {}\n", "java") == ["import a.b.C;"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [("test_file.py", HELLO), ("payment.py", PAYMENT), ("x.py", "def helper():\n    pass\n\ndef main():\n    helper()\n    x = helper\n"), ("notes.txt", "nothing")]
    out = ingest.build(spark, spark.createDataFrame(rows, "path string, content string"))
    return CodeIndex(**{n: df.cache() for n, df in out.tables().items()})


def test_build(index):
    assert {r.path: r.lang for r in index.files.collect()} == {"test_file.py": "python", "payment.py": "python", "x.py": "python", "notes.txt": None}
    assert {r.qualified_name for r in index.symbols.collect()} >= {"test_file.hello_world", "test_file.MyClass", "test_file.method"}
    edges = {(r.caller_name, r.callee_name, r.callee_file) for r in graph.edge_view(index).collect()}
    assert edges == {("hello_world", "print", None), ("charge_customer", "validate_card", "payment.py"), ("main", "helper", "x.py")}
    assert {(r.depth) for r in index.closure.collect()} == {1} and index.closure.count() == 2


def test_queries(index):
    assert [r.entry for r in symbols.search_symbol(index.symbols, index.files, "hello").collect()] == ["hello_world:f:test_file.py:1-2"]
    assert [(r.caller_name, r.caller_file, r.caller_line) for r in graph.callers(graph.edge_view(index), "validate_card").collect()] == [("charge_customer", "payment.py", 4)]
    assert [r.callee_name for r in graph.callees(graph.edge_view(index), "charge_customer").collect()] == ["validate_card"]
    listed, edges = symbols.repo_overview(index.symbols, index.files, graph.edge_view(index), file_filter=["payment.py"])
    assert [(r.caller, r.callees) for r in edges.collect()] == [("charge_customer@4", "validate_card")]
    assert listed.first().symbols == "validate_card:f:1-2 charge_customer:f:4-6"
    with pytest.raises(ValueError):
        symbols.repo_overview(index.symbols, index.files, graph.edge_view(index))
    assert {r.name for r in audit.unused_symbols(index).collect()} == {"charge_customer", "main", "hello_world", "method"}
    assert sorted(r.line for r in symbols.find_usages(index.symbol_references, index.symbols, index.files, "helper").collect()) == [5, 6]
    assert symbols.get_docstring(index.docstrings, index.symbols, index.files, "hello_world").count() == 0
    body = symbols.function_body(index.lines, index.files, "payment.py", 4, 6, max_lines=2).first()
    assert body.body == "def charge_customer():\n    validate_card()" and body.has_more and body.next_window_start == 6
    one = symbols.extract_by_name(index.symbols, index.files, index.lines, "charge_customer").first()
    assert one.signature == "def charge_customer():" and "validate_card()" in one.source
    ctx = symbols.edit_context(index, "validate_card").first()
    assert ctx.candidates == 1 and ctx.callers == ["charge_customer"]
    assert symbols.get_definition(index.symbols, index.files, index.lines, "payment.py", "validate_card").first().source == "def validate_card():\n    return True"


def test_search(index):
    row = textsearch.search_code(index.lines, index.files, "print", lang="python", limit=10).first()
    assert (row.line, row.col, row.text) == (2, 4, "    print('Hello World')")
    assert textsearch.search_code(index.lines, index.files, "  ").count() == 0
    assert [r.path for r in textsearch.find_file(index.files, "test_file").collect()] == ["test_file.py"]
    assert {r.path for r in textsearch.find_file(index.files, "*.py").collect()} == {"test_file.py", "payment.py", "x.py"}
    multi = textsearch.search_code(index.lines, index.files, "World')\n\nclass").collect()
    assert [(r.file, r.line) for r in multi] == [("test_file.py", 2)]
    rows = textsearch.read_scattered(index.lines, index.files, "payment.py", [2, 99, 1]).collect()
    assert [(r.line, r.error) for r in rows] == [(2, None), (99, "out of range"), (1, None)]
    assert textsearch.read_file(index.lines, index.files, "payment.py", 1, 2).first().content == "1: def validate_card():\n2:     return True"
    with pytest.raises(ValueError):
        textsearch.read_lines(index.lines, index.files, "payment.py", 0)
    assert [(r.file, r.line) for r in textsearch.symbol_or_grep(index.lines, index.files, index.symbols, "def helper():").collect()] == [("x.py", 1)]


def test_context_frames(spark):
    files = spark.createDataFrame([(1, "a.txt", None)], "id long, path string, lang string")
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["one", "hit a", "three", "hit b", "five"], 1)], "file_id long, line_no int, text string")
    rows = textsearch.search_code(lines, files, "hit", context=1).collect()
    assert [(r.line, r.before, r.after) for r in rows] == [(2, ["one"], ["three"]), (4, ["three"], ["five"])]
    many = spark.createDataFrame([(1, k, "hit") for k in range(1, 31)], "file_id long, line_no int, text string")
    assert textsearch.search_code(many, files, "hit", limit=50).count() == 20


def test_tier_two_and_ambiguous(spark):
    rows = [("pkg/mod.py", "def f():\n    pass\n"), ("other.py", "def f():\n    pass\n"), ("use.py", "from pkg.mod import f\ndef g():\n    f()\n"), ("lost.py", "def h():\n    f()\n")]
    index = ingest.build(spark, spark.createDataFrame(rows, "path string, content string"))
    got = {(r.caller_name, r.callee_file) for r in graph.edge_view(index).filter("callee_name = 'f'").collect()}
    assert got == {("g", "pkg/mod.py"), ("h", None)}
    assert {(r.path, r.name) for r in audit.unresolved_calls(index).collect()} == {("lost.py", "f")}
    assert audit.unused_imports(index).count() == 0
    assert audit.find_unused(index, "imports", max_unresolved=0.1)[0]["blocked"]
    assert [r.path for r in deps.importers(index.imports, index.files, "pkg").collect()] == ["use.py"]


def test_nested_functions(spark):
    index = ingest.build(spark, spark.createDataFrame([("n.py", "def outer():\n    def inner():\n        deep()\n    inner()\n")], "path string, content string"))
    assert {(r.caller_name, r.callee_name) for r in graph.edge_view(index).collect()} == {("inner", "deep"), ("outer", "inner")}


def test_like_wildcards(spark):
    rows = spark.createDataFrame([(1, 1, n, "function", 1, 1, n) for n in ("a_c", "axc", "A_C")], "id long, file_id long, name string, kind string, line_start int, line_end int, qualified_name string")
    files = spark.createDataFrame([(1, "f.py")], "id long, path string")
    assert [r.name for r in symbols.search_symbol(rows, files, "a_c").collect()] == ["a_c", "A_C", "axc"]
    assert [r.name for r in symbols.search_symbol(rows, files, "a_c", escape=True).collect()] == ["a_c", "A_C"]
    with pytest.raises(ValueError):
        symbols.search_symbol(rows, files, "a")


def test_store_is_incremental(spark, tmp_path):
    v1 = [("a.py", "def a():\n    b()\n"), ("b.py", "def b():\n    pass\n"), ("c.py", "def c():\n    b()\n")]
    store = ingest.Store(spark, str(tmp_path / "store"))
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    store.apply(frame(v1))
    store.apply(frame([("a.py", "def a():\n    c()\n"), ("c.py", v1[2][1])]), spark.createDataFrame([("b.py",)], "path string"))
    got, full = store.index(), ingest.build(spark, frame([("a.py", "def a():\n    c()\n"), v1[2]]))
    for name in ("files", "symbols", "call_edges", "symbol_references", "closure", "lines"):
        a, b = getattr(got, name), getattr(full, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), name
    states = {r.path: r.state for r in ingest.changes(ingest.file_table(frame(v1)), ingest.file_table(frame([v1[0], ("b.py", "x"), ("d.py", "")]))).collect()}
    assert states == {"a.py": "unchanged", "b.py": "changed", "c.py": "deleted", "d.py": "new"}


def test_cascade_and_orphans(spark, index):
    gone = index.files.filter("path = 'payment.py'").select("id")
    left = ingest.cascade(index, gone)
    assert {r.n for r in audit.orphan_counts(left).collect()} == {0}
    assert left.symbols.count() == index.symbols.count() - 2
    broken = CodeIndex(**(index.tables() | {"call_edges": index.call_edges.unionByName(spark.createDataFrame([(404, "x", 1, 0, None, None, None)], index.call_edges.schema))}))
    assert {r.relation: r.n for r in audit.orphan_counts(broken).collect()}["call_edges"] == 1
    assert audit.health(broken).first().status == "degraded"


def test_scan_tree(spark, tmp_path):
    for path, text in (("src/a.py", "x = 1\n"), ("src/b.RS", "fn f() {}\n"), ("node_modules/c.js", ""), ("readme.md", "")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    for f in (scan.scan_tree, tree.scan):
        assert {(r.path, r.lang) for r in f(spark, str(tmp_path)).collect()} == {("src/a.py", "python"), ("src/b.RS", "rust")}
    files = spark.createDataFrame([("src/b/x.py", "python"), ("src/a.py", "python"), ("Readme.md", None), ("pom.xml", None), ("src/b/__init__.py", "python")], "path string, lang string")
    assert [r.path for r in scan.tree(files).collect()] == ["src", "src/b", "src/b/__init__.py", "src/b/x.py", "src/a.py", "pom.xml", "Readme.md"]
    assert scan.detect_stack(files).first().stack == "java-maven"
    assert {(r.kind, r.value) for r in scan.suggest(files, "B").collect()} == {("directory", "src/b"), ("package", "src.b")}
    assert [(r.directory, r.n_files) for r in scan.list_workspace(files).collect()] == [("src", 3)]
    snippets = spark.createDataFrame([("fn f() {} impl X {}",), ("func F() {}",), ("def f(): pass",), ("public class A {}",), ("const x = 1",), ("hm",)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in snippets.select(scan.guess_language(F.col("t"))).collect()] == ["rust", "go", "python", "java", "javascript", "python"]


def test_blocks():
    got = [(b.kind, b.name) for b in blocks.parse_blocks("import os\nMAX = 3\ndef f():\n    pass\n-----\nclass A:\n    x = 1\nprint(1)\n")]
    assert got == [("import", None), ("constant", "MAX"), ("function", "f"), ("class", "A"), ("other", None)]
    assert blocks.find_bounds("x = 1\n@dec\ndef f():\n    pass\n\ny = 2\n", "f", "function") == (1, 4)
    text, done = blocks.apply_code("import os\n\ndef f():\n    return 1\n\nX = 1\n", "import sys\nX = 2\ndef f():\n    return 2\ndef g():\n    return 3\n", "a.py")
    assert text == "import os\nimport sys\n\ndef f():\n    return 2\n\nX = 2\n\ndef g():\n    return 3\n" and [a for *_, a in done] == ["merged", "replaced", "replaced", "appended"]
    text, _ = blocks.apply_code("class A:\n    def f(self):\n        return 1\n\nclass B:\n    pass\n", "def f(self):\n    return 2\n", "a.py")
    assert text == "class A:\n    def f(self):\n        return 2\n\nclass B:\n    pass\n"
    assert blocks.merge_imports(["import a", "", "x"], "import a\nimport b") == ["import a", "import b", "", "x"]
    assert blocks.constant_bounds(["A = [", "  1,", "]", "B = 2"], "A") == (0, 3)
    assert [(b.kind, b.name) for b in blocks.parse_blocks("import x from 'y';\nfunction f() {\n  return 1;\n}\nclass C {\n}\n", "a.js")] == [("import", None), ("function", "f"), ("class", "C")]


def test_error_context_and_original(index):
    from tarnwell.operators import context

    got = context.error_context(index, "NameError: validate_card is wrong", "payment.py", 5)
    assert got["function"].first().name == "charge_customer" and got["line"].first().text == "    validate_card()"
    assert context.error_context(index, "x", "payment.py", 2)["callers"].first().caller_name == "charge_customer"
    best = context.detect_original(index, "def validate_card():\n    return False\n", hint="payment.py").first()
    assert (best.path, best.source) == ("payment.py", "def validate_card():\n    return True")
    with pytest.raises(ValueError):
        context.detect_original(index, "1 + 1")


def test_sources_that_do_not_parse_keep_what_stands_before():
    names = lambda text: [r[1] for r in extract.facts(text, "python") if r[0] == "symbol"]
    errors = lambda text: [r[3] for r in extract.facts(text, "python") if r[0] == "error"]
    good = "@deco\ndef f(): return 1\n\n\nclass A:\n    def g(self):\n        pass\n"
    assert names(good + "print 'x'\n") == ["f", "A", "g"] and errors(good + "print 'x'\n") == [8] and errors(good) == []
    assert names("def f(): return 1\n@deco\ndef g(x:\n    return 1\n") == ["f"]
    assert names("def f(): return 1\nclass B:\n    def g(self):\n        print 'x'\n    def h(self): pass\n") == ["f"]
    assert names("print 'x'\ndef f(): pass\n") == [] and errors("print 'x'\n") == [1]
    assert errors("x = " + "-" * 50_000 + "1") == [1] and errors("\0") == [1]
    assert extract.raw_imports("import os\nimport sys\nprint 'x'\n", "python") == ["import os", "import sys"]
    text = "\r\n".join(["async def ü(a, /, *b: int, c=')'):", "\tif a: {", "\t\t'}': 1}", "\tdef inner(): pass", "", "class É(dict): x = lambda s: '#'"])
    assert sorted(names(text)) == ["inner", "x", "É", "ü"]
