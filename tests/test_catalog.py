"""Every registered query gives the rows of its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from weftwork.catalog.check import compare, duckdb_over
from weftwork.catalog.registry import QUERIES, SQL

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duckdb_over(ROOT)


# A tiny table may hold no case of one rule; both sides must then be empty alike.
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, ROOT, QUERIES[name], SQL[name]) in ("", "both empty")


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) <= set(entry.queries())


def test_lookups_over_whole_tables_have_hits_and_misses(spark):
    customers = spark.read.parquet(f"{ROOT}/customer.parquet").count()
    hits = QUERIES["connected_all"](spark, ROOT).filter("first_order IS NOT NULL").count()
    assert hits == QUERIES["unconnected_all"](spark, ROOT).filter("doubled >= 0").count()
    orders = spark.read.parquet(f"{ROOT}/orders.parquet")
    assert 0 < hits == orders.filter("o_custkey % 5 <> 0").select("o_custkey").distinct().count() < customers
    shifted = QUERIES["nearest_date_all"](spark, ROOT).filter("dayofmonth(requested) % 3 = 0 AND requested <> nearest").count()
    assert shifted > 0
