"""Every registered query of the engine against the SQL that states its result."""

import duckdb
import pytest

from sheafwork.queries import ORACLE_SQL, QUERIES
from sheafwork.queries.inputs import TABLES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    want = duck.sql(ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    ours = sorted([tuple(plain(row[c]) for c in names) for row in found.collect()], key=str)
    order = [want.columns.index(c) for c in names]
    theirs = sorted([tuple(plain(row[k]) for k in order) for row in want.fetchall()], key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_weighted_ratio_is_no_less_than_plain(spark, small):
    plain_rows = {r["c_custkey"]: r["ratio"] for r in QUERIES["fuzzy_ratio"](spark, small).collect()}
    for r in QUERIES["fuzzy_weighted"](spark, small).collect():
        assert r["weighted"] >= plain_rows[r["c_custkey"]] - 1e-6


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
