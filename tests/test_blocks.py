"""Blocks: rows are dealt out before they are parsed, names are found without a pattern each, a file is parsed once."""

import re

from pyspark.sql import functions as F

from tarnwell.functions import blocks, extract
from tarnwell.plans import rendered


def test_parts_of_one_small_file_go_to_many_tasks(spark, tmp_path):
    n = 3 * rendered.EACH
    spark.range(1, n + 1).select(F.col("id").cast("int").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = rendered.parts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 3 and sum(r["count"] for r in tasks) == n


def test_bounds_compile_no_pattern_for_a_name(monkeypatch):
    lines = ["class A:", "    @x", "    async  def  run(self):", "        pass", "", "class AB:", "    def run_(self):", "        pass", "export const LIMIT: int = [", "  1]", "const = 2"]
    made = []
    monkeypatch.setattr(re, "match", lambda *a: made.append(a))
    assert blocks.indented_bounds(lines, "run", "function", "A") == (1, 4)
    assert blocks.indented_bounds(lines, "run_", "function", "AB") == (6, 8)
    assert blocks.indented_bounds(lines, "B", "class") is None
    assert blocks.constant_bounds(lines, "LIMIT") == (8, 10) and blocks.constant_bounds(lines, "const") == (10, 11) and blocks.constant_bounds(lines, "IMIT") is None
    assert not made


def test_edits_of_a_file_parse_it_once(monkeypatch):
    source = "class A:\n    def run(self):\n        pass\n\n\ndef f():\n    return lambda: 1\n\n\ng = lambda x: x\nif f:\n    class B:\n        def run(self): ...\n"
    rows = [r for r in extract.facts(source, "python") if r[0] == "symbol"]
    extract.definitions.cache_clear()
    parsed, seen = extract.parsed, []
    monkeypatch.setattr(extract, "parsed", lambda s: seen.append(s) or parsed(s))
    assert list(extract.definitions(source, "python")) == rows and len(rows) == 6
    for name in ("run", "f", "g"):
        blocks.apply_code(source, f"def {name}():\n    return 2", "a.py")
    assert seen == [source]
