"""Every registered query against its DuckDB oracle on the smallest test data.

Order-insensitive comparison of column names and values, the same check the
driver runs at sf0.01.
"""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import oracle_queries
from seatspark.catalog import queries as catalog_queries
from conftest import SMALL_SF

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, Decimal):
        return str(v.normalize())
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(_norm(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in SOURCES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return con


QUERIES = catalog_queries()
ORACLE = oracle_queries()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL_SF)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [c[0] for c in res.description]
    want = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(got) == len(want)
    assert _canon(cols, got) == _canon(ocols, want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["movie_id", "title", "total_revenue"]
    assert df.count() >= 0
