"""Queries for sinks: each writes a target below the shared folder and reads it back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from weftwork.catalog.registry import query
from weftwork.session import fresh_path
from weftwork.sources import targets as W

c = F.col
_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _orders(t, cond="true"):
    return t.orders.filter(cond).select(*_COLS.split(", "))


def _written(t, label, *writes):
    path = fresh_path(t.spark, label)
    for df, mode, *parts in writes:
        W.write_target(df, path, mode, *parts)
    return t.spark.read.parquet(path)


@query("write_append", f"SELECT {_COLS} FROM orders UNION ALL SELECT {_COLS} FROM orders WHERE o_orderstatus = 'F'")
def write_append(t):
    return _written(t, "append", (_orders(t), W.APPEND), (_orders(t, "o_orderstatus = 'F'"), W.APPEND)).select(*_COLS.split(", "))


@query("write_truncate_insert", f"SELECT {_COLS} FROM orders WHERE o_totalprice > 100000")
def write_truncate_insert(t):
    return _written(t, "truncate", (_orders(t), W.APPEND), (_orders(t, "o_totalprice > 100000"), W.TRUNCATE_INSERT))


@query("write_partitioned", """
SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS PARTITION_KEY FROM orders""")
def write_partitioned(t):
    keyed = W.partition_by(t.orders, W.MONTHLY, "o_orderdate").select("o_orderkey", "PARTITION_KEY")
    return _written(t, "monthly", (keyed, W.APPEND, ["PARTITION_KEY"])).select("o_orderkey", "PARTITION_KEY")


@query("write_delta_partitioned", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, 'old' AS load FROM orders WHERE o_orderstatus <> 'O' AND NOT (o_orderstatus = 'P' AND o_orderpriority = '2-HIGH')
UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, 'new' FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000
UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, 'sub' FROM orders
  WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AND o_totalprice <= 200000""")
def write_delta_partitioned(t):
    parts = ["o_orderstatus", "o_orderpriority"]
    rows = lambda cond, load: t.orders.filter(cond).select("o_orderkey", *parts, F.lit(load).alias("load"))
    by_status = _written(t, "delta", (rows("true", "old"), W.APPEND, parts[:1]),
                         (rows("o_orderstatus = 'O' AND o_totalprice > 200000", "new"), W.DELTA_PARTITIONED, parts[:1]))
    return _written(t, "subdelta", (by_status, W.APPEND, parts),
                    (rows("o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AND o_totalprice <= 200000", "sub"), W.DELTA_SUB_PARTITIONED, parts)
                    ).select("o_orderkey", *parts, "load")


@query("write_upsert", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal FROM supplier""")
def write_upsert(t):
    old = t.customer.select("c_custkey", "c_name", "c_acctbal")
    changed = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", (c("c_acctbal") + 1).alias("c_acctbal"))
    added = t.supplier.select((c("s_suppkey") + 1000000000).alias("c_custkey"), c("s_name").alias("c_name"), c("s_acctbal").alias("c_acctbal"))
    return _written(t, "upsert", (W.upsert(old, changed.unionByName(added), ["c_custkey"]), W.TRUNCATE_INSERT))


@query("write_upsert_partitions", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 20 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + 1 AS o_totalprice
  FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 10 = 0)
SELECT * FROM s UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)""")
def write_upsert_partitions(t):
    """Orders upserted in place: some change, some move to a new partition, one partition empties; each change comes twice."""
    path = fresh_path(t.spark, "orders")
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    orders.write.partitionBy("o_orderstatus").parquet(path)
    moves = F.when((c("o_orderstatus") == "P") | (c("o_orderkey") % 20 == 0), "M").otherwise(c("o_orderstatus"))
    changed = orders.filter("o_orderstatus = 'P' OR o_orderkey % 10 = 0").withColumns({"o_orderstatus": moves, "o_totalprice": c("o_totalprice") + 1})
    W.upsert_table(changed.withColumn("o_totalprice", c("o_totalprice") - 2).unionByName(changed), path, ["o_orderkey"], "o_orderstatus", ["o_totalprice"])
    return t.spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("multi_target", """
SELECT 'detail' AS target, o_orderkey AS k, round(o_totalprice, 1) AS v FROM orders
UNION ALL SELECT 'flags', o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O'""")
def multi_target(t):
    parent = t.orders.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 1).alias("o_totalprice"))
    root = fresh_path(t.spark, "multi")
    W.write_targets(parent, {f"{root}/detail": (lambda p: p.select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v")), W.APPEND),
                             f"{root}/flags": (lambda p: p.filter("o_orderstatus = 'O'").select(c("o_orderkey").alias("k"), F.lit(1.0).alias("v")), W.APPEND)})
    back = lambda n: t.spark.read.parquet(f"{root}/{n}").select(F.lit(n).alias("target"), "k", "v")
    return back("detail").union(back("flags"))


@query("write_dated_feed", """
SELECT o_orderkey, o_orderstatus, 'feed_20240229_20240301_01032024101112.csv' AS file FROM orders""")
def write_dated_feed(t):
    root = fresh_path(t.spark, "feed")
    path = W.write_feed(t.orders.select("o_orderkey", "o_orderstatus"), root + "/feed_$$Date_YYYYMMDD_DDMMYYYYHH24MMSS.csv", datetime(2024, 3, 1, 10, 11, 12))
    rows = t.spark.read.schema("o_orderkey bigint, o_orderstatus string").option("header", True).csv(path)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "/(feed_[^/]*)/", 1))
