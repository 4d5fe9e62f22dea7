"""Queries with SQL give its rows; every numbered operator is registered once and the rest of the library imports none of them."""

import os
import re

import pytest

import __spark_entry__ as entry
from weftwork.catalog.check import compare, duckdb_over
from weftwork.llm.queries import QUERIES, SQL

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duckdb_over(ROOT)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, ROOT, QUERIES[name], SQL[name]) == ""


def test_all_operators_are_registered():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(os.path.join(root, "weftwork")):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "weftwork.llm" not in text.read(), f
