"""The registry: query name → (function of the tables, checking SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of a directory as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = tune(spark, fine=True), root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A view in the SQL both engines share, over the tables it names in braces."""
        names = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if "{" + n + "}" in text]
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def duck(view: str) -> str:
    """The shared view text for the checking engine, where tables are plain names."""
    return view.replace("{", "").replace("}", "")
