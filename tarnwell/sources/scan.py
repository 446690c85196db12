"""Source trees and other inputs as data frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by suffix, names that a language filter may use, folders that are not indexed, folders that are
# not searched, and languages of all suffixes that a summary knows.
LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust"}
LANGUAGE_ALIASES = {"python": "python", "py": "python", "java": "java", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "go": "go", "rust": "rust", "rs": "rust"}
SKIP_DIRS = (
    ".git", ".svn", ".hg", "node_modules", ".next", ".nuxt", ".turbo", "coverage", "__pycache__", ".venv", "venv", ".venv-mcp", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox",
    "target", "build", ".gradle", ".idea", "bin", "out", "vendor", "dist", ".eggs", ".vscode", ".vs", ".eclipse", "tmp", "temp", "logs",
)
SEARCH_SKIP = (
    ".git", ".svn", ".hg", ".idea", ".vscode", ".eclipse", ".project", ".venv", ".venv-mcp", "venv", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".nox", "*.egg-info",
    "node_modules", ".npm", ".yarn", "dist", "build", ".next", ".nuxt", "target", ".gradle", ".m2", "out", "bin", "vendor", ".code-scan", ".semgrep",
)
SUFFIX_LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "sql": "sql",
    "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "toml": "toml", "sh": "shell",
}
#: A snippet is of the first language of which every list has a keyword in it.
KEYWORDS = (
    ("rust", (("fn ",), ("impl ", "pub "))),
    ("go", (("func ",),)),
    ("python", (("def ",),)),
    ("python", (("import ",), (":",))),
    ("java", (("class ",), ("public ", "private ", "void "))),
    ("javascript", (("const ", "let ", "function ", "async ", "=>"),)),
)
# End of fixed values.


def detect_language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in LANGUAGES.items()])


def guess_language(text: Column) -> Column:
    """A snippet's language by its keywords; Python where none tells."""
    out = F
    for lang, lists in KEYWORDS:
        found = F.lit(True)
        for words in lists:
            found = found & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        out = out.when(found, F.lit(lang))
    return out.otherwise(F.lit("python"))


def in_skipped(path: Column, skip=SKIP_DIRS) -> Column:
    """Whether a folder of the path is skipped; `*.x` skips by ending."""
    parts = F.split(path, "/")
    plain = [s for s in skip if "*" not in s]
    out = F.arrays_overlap(parts, F.array(*map(F.lit, plain)))
    for s in skip:
        if s.startswith("*"):
            out = out | F.regexp_like(path, F.lit(r"(^|/)[^/]*\Q" + s[1:] + r"\E(/|$)"))
    return out


def scan_tree(spark: SparkSession, root: str, skip=SKIP_DIRS) -> DataFrame:
    """path (below root), lang, mtime, hash, content of all source files of a tree: one distributed listing and read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/+", "/")
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    below = F.when(F.startswith(plain, base), F.substring(plain, F.length(base) + 2, F.length(plain))).otherwise(plain)
    files = raw.withColumn("below", below).withColumn("lang", detect_language(F.col("below"))).filter(F.col("lang").isNotNull() & ~in_skipped(F.col("below"), skip))
    return files.select(F.col("below").alias("path"), "lang", F.col("modificationTime").cast("double").alias("mtime"), F.md5("content").alias("hash"), F.decode("content", "UTF-8").alias("content"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an exported `hash|date|subject` log."""
    return spark.read.text(path)


FINDING = (
    "results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,`end`:struct<line:int,col:int>,extra:struct<message:string,severity:string,lines:string,metadata:struct<confidence:string,category:string,cwe:string>>>>"
)
# Severities of findings.
SEVERITIES = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
# End of fixed values.


def scan_findings(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a scanner's JSON report: severities in three grades, rule ids without their path, snippets of 500 characters."""
    r = raw.select(F.explode(F.from_json(column, FINDING)["results"]).alias("r"))
    level = F.upper("r.extra.severity")
    grade = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in SEVERITIES.items()], F.lit("LOW"))
    return r.select(
        F.substring_index("r.check_id", ".", -1).alias("rule"), grade.alias("severity"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"), F.col("r.start.col").alias("col_start"), F.col("r.end.col").alias("col_end"),
        F.col("r.extra.message").alias("message"), F.substring("r.extra.lines", 1, 500).alias("snippet"), F.coalesce(F.expr("try_cast(r.extra.metadata.confidence AS double)"), F.lit(0.8)).alias("confidence"), F.col("r.extra.metadata.category").alias("category"),
    )


def finding_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("n_findings"), F.count_distinct("file").alias("n_files"))


def list_workspace(files: DataFrame) -> DataFrame:
    """Top folders of a listing (path, lang): whether they hold a .git folder, and their source files."""
    top = F.substring_index("path", "/", 1)
    rows = files.filter(F.contains("path", F.lit("/")))
    return rows.groupBy(top.alias("directory")).agg(F.max(F.contains("path", F.lit("/.git/"))).alias("has_git"), F.count_if(F.col("lang").isNotNull()).alias("n_files")).orderBy("directory")


def tree(files: DataFrame) -> DataFrame:
    """Entries of a directory tree in the order that a listing shows them: folders before files, then by lower-case name."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.slice(parts, F.lit(1), k).alias("parts"), (k == F.size(parts)).alias("is_file")))
    rows = files.select(F.explode(prefixes).alias("p")).select("p.parts", "p.is_file").distinct()
    depth = F.size("parts")
    key = F.array_join(F.transform("parts", lambda x, i: F.concat(F.when(F.col("is_file") & (i == F.size("parts") - 1), "1").otherwise("0"), F.lower(x), F.lit("\x01"), x)), "\x00")
    return rows.select(depth.alias("depth"), F.element_at("parts", -1).alias("name"), "is_file", F.array_join("parts", "/").alias("path"), key.alias("sort_key")).orderBy("sort_key").drop("sort_key")


def suggest(files: DataFrame, query: str) -> DataFrame:
    """Folders, and packages (folders with __init__.py, in dots), that hold a text."""
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    dirs = files.filter(F.contains("path", F.lit("/"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("value"))
    packages = files.filter(F.endswith("path", F.lit("/__init__.py"))).select(F.replace(F.regexp_replace("path", "/__init__\\.py$", ""), F.lit("/"), F.lit(".")).alias("value"))
    both = dirs.select(F.lit("directory").alias("kind"), "value").unionByName(packages.select(F.lit("package").alias("kind"), "value")).distinct()
    return both.filter(F.contains(F.lower("value"), F.lit(query.lower()))).orderBy("kind", "value")


# The build stacks, in the order in which their files are looked for.
STACK_FILES = (
    ("pom.xml", "java-maven"), ("build.gradle", "java-gradle"), ("build.gradle.kts", "java-gradle"), ("package.json", "node"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("pyproject.toml", "python"),
    ("setup.py", "python"), ("requirements.txt", "python"), ("Gemfile", "ruby"), ("composer.json", "php"), ("CMakeLists.txt", "cpp"), ("Makefile", "cpp"),
)
# End of fixed values.


def detect_stack(files: DataFrame) -> DataFrame:
    """One row: the stack of the first indicator file at a tree's root, or null."""
    known = files.sparkSession.createDataFrame([(k, f, s) for k, (f, s) in enumerate(STACK_FILES)], "place int, path string, stack string")
    return files.select("path").join(F.broadcast(known), "path").agg(F.min_by("stack", "place").alias("stack"))
