"""Registered queries against their SQL twins on the smallest tables (skipped where those are absent)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import REGISTRY
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_query_equals_sql(spark, tables, name):
    q = REGISTRY[name]
    assert compare(q(spark, FOLDER).toPandas(), tables.execute(q.sql).df()).startswith("ok")


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
