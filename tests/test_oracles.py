"""Every registered query against its checking SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from linktrove.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def canonical(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted([tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows], key=lambda t: [(v is not None, v) for v in t])


@pytest.mark.parametrize("name", list(entry_module.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    expected = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert canonical(df.columns, rows) == canonical(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())
