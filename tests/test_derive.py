"""Relations of the test tables that queries share."""

import os
import shutil

from tarnwell.plans import queries
from tarnwell.plans.derive import derive


def derived(spark):
    at = spark.conf.get("spark.checkpoint.dir")
    return {f"{d}/{n}": os.stat(f"{at}/{d}/{n}").st_mtime_ns for d in os.listdir(at) if d.startswith("derived-") for n in os.listdir(f"{at}/{d}") if not n.startswith(".")}


def copied(sf, at):
    for t in ("documents", "pages", "events", "embeddings"):
        shutil.copy(f"{sf}/{t}.parquet", at)
    return str(at)


def test_joins_are_made_once(spark, sf, tmp_path):
    """Many queries make each relation once, and none that they don't use."""
    at, before = copied(sf, tmp_path), derived(spark)
    new = lambda: {p: t for p, t in derived(spark).items() if p not in before}
    queries.QUERIES["files"](spark, at).collect()
    queries.QUERIES["grep_literal"](spark, at).collect()
    assert not new()
    queries.QUERIES["symbol_search_ranked"](spark, at).collect()
    assert [p.split("/")[1] for p in new()] == ["symbols"]
    queries.QUERIES["health"](spark, at).collect()
    made = new()
    assert sorted(p.split("/")[1] for p in made) == ["call_edges", "imports", "symbol_references", "symbols"]
    queries.QUERIES["unused_symbols"](spark, at).collect()
    queries.QUERIES["overview_edges"](spark, at).collect()
    assert new() == made


def test_changed_tables_are_read_again(spark, sf, tmp_path):
    """Other rows below the same path give another index."""
    at = copied(sf, tmp_path)
    count = lambda: derive(spark, at).symbols.count()
    whole = count()
    assert count() == whole > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.filter("lang = 'fr'").write.parquet(f"{at}/new")
    os.remove(f"{at}/documents.parquet")
    os.rename(f"{at}/new", f"{at}/documents.parquet")  # a folder of files now
    assert 0 < count() < whole
    docs.limit(0).write.mode("append").parquet(f"{at}/documents.parquet")
    assert 0 < count() < whole


def test_all_relations_have_their_schema(spark, sf):
    index = derive(spark, sf)
    from tarnwell.plans.index import SCHEMAS

    for name, df in index.tables().items():
        declared = spark.createDataFrame([], SCHEMAS[name]).schema
        assert {f.name: f.dataType for f in df.schema} == {f.name: f.dataType for f in declared if f.name in df.columns}, name
