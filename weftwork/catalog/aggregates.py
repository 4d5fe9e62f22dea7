"""Queries for aggregation, duplicates and latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import RUNS
from weftwork.operators import aggregates as A
from weftwork.operators import windows as W

c = F.col
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]


@query("group_aggregate", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n, count(nullif(l_discount, 0)) AS discounted,
  max(l_shipdate) AS last_ship, min(l_shipdate) AS first_ship, round(avg(l_extendedprice), 4) AS avg_price
FROM lineitem GROUP BY 1, 2""")
def group_aggregate(t):
    return A.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "qty": F.round(A.sum_(c("l_quantity")), 2), "n": A.count_(), "discounted": A.count_(F.nullif(c("l_discount"), F.lit(0.0))),
        "last_ship": A.max_(c("l_shipdate")), "first_ship": A.min_(c("l_shipdate")), "avg_price": F.round(A.avg_(c("l_extendedprice")), 4)})


@query("passthrough_last", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS total, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1""")
def passthrough_last(t):
    return A.aggregate(t.orders, ["o_custkey"], {"total": F.round(A.sum_(c("o_totalprice")), 2)},
                       ["o_orderkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@query("global", "SELECT count(*) AS n, round(sum(o_totalprice), 1) AS total, max(o_orderdate) AS newest FROM orders")
def global_(t):
    return A.aggregate(t.orders, [], {"n": A.count_(), "total": F.round(A.sum_(c("o_totalprice")), 1), "newest": A.max_(c("o_orderdate"))})


@query("filtered_aggregate", """
SELECT l_suppkey, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS returned, count(*) FILTER (WHERE l_tax > 0.05) AS taxed,
  max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_max FROM lineitem GROUP BY 1""")
def filtered_aggregate(t):
    return A.aggregate(t.lineitem, ["l_suppkey"], {
        "returned": F.round(A.sum_(c("l_quantity"), c("l_returnflag") == "R"), 2), "taxed": A.count_(where=c("l_tax") > 0.05),
        "open_max": A.max_(c("l_quantity"), c("l_linestatus") == "O")})


@query("expression_over_aggregate", """
SELECT l_partkey, sum(l_quantity * 2 + 1) / count(*) AS mean_doubled,
  CASE WHEN max(l_quantity) > 45 THEN 'big' ELSE 'small' END AS size FROM lineitem GROUP BY 1""")
def expression_over_aggregate(t):
    mean = A.sum_(c("l_quantity") * 2 + 1) / A.count_()
    return A.aggregate(t.lineitem, ["l_partkey"], {"mean_doubled": mean, "size": F.when(A.max_(c("l_quantity")) > 45, "big").otherwise("small")})


def _rank_sql(p: float) -> str:
    return f"max(CASE WHEN r = greatest(1, least(n, CAST(ceil({p} / 100.0::DOUBLE * n) AS BIGINT))) THEN v END)"


@query("nearest_rank_percentile", f"""
SELECT event_type, {_rank_sql(50)} AS p50, {_rank_sql(95)} AS p95, {_rank_sql(99)} AS p99, {_rank_sql(0)} AS p0 FROM (
  SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n
  FROM events) e GROUP BY 1""")
def nearest_rank_percentile(t):
    return A.percentile_nearest_rank(t.events, ["event_type"], "value", {"p50": 50, "p95": 95, "p99": 99, "p0": 0})


@query("conditional_counts", f"""
SELECT recipe_filename, count(*) FILTER (WHERE status = 'SUCCESS') AS ok, count(*) FILTER (WHERE status = 'FAILED') AS ko
FROM ({duck(RUNS)}) r GROUP BY 1""")
def conditional_counts(t):
    return A.status_counts(t.sql(RUNS), ["recipe_filename"])


@query("duplicate_flag", f"""
SELECT {', '.join(_LINE)}, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE)}) > 1
  THEN 'Y' ELSE 'N' END AS FLAG_DUPLICADO FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem) l""")
def duplicate_flag(t):
    """Every line twice, so that equal rows are told apart too."""
    lines = t.lineitem.select(*_LINE)
    return W.flag_duplicates(lines.unionAll(lines), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("latest_per_key", f"""
SELECT recipe_filename, arg_max(run_date, run_date) AS run_date, arg_max(status, run_date) AS status, arg_max(job_id, run_date) AS job_id,
  arg_max(cluster_name, run_date) AS cluster_name FROM ({duck(RUNS)}) r GROUP BY 1""")
def latest_per_key(t):
    return W.latest_per_key(t.sql(RUNS), ["recipe_filename"], ["run_date", "status", "job_id", "cluster_name"], ["run_date"])


@query("history_strip", f"""
SELECT recipe_filename, string_agg(CAST(run_date AS VARCHAR) || ':' || status, ',' ORDER BY run_date) AS strip
FROM ({duck(RUNS)}) r GROUP BY 1""")
def history_strip(t):
    out = W.history(t.sql(RUNS), "recipe_filename", ["status"])
    return out.select("recipe_filename", F.array_join(F.transform(
        "history", lambda h: F.concat_ws(":", h["run_date"].cast("string"), h["status"])), ",").alias("strip"))


@query("first_match", "SELECT o_custkey, arg_min(o_orderstatus, (o_orderpriority, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def first_match(t):
    return W.first_by(t.orders, ["o_custkey"], ["o_orderstatus"], ["o_orderpriority", "o_orderkey"])
