"""Every registered query of the index against its SQL in another engine."""

import duckdb
import pytest

from tarnwell.plans import changing, queries, rendered, searching  # noqa: F401

TABLES = "part supplier events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf, other):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in queries.ORACLE:
        rel = other.sql(queries.ORACLE[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.HEADLINE) <= set(queries.QUERIES)
    assert entry.entry(spark).columns
