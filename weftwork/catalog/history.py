"""Queries for operational analytics over job-history runs derived from the events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from weftwork.catalog import nested
from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import ENTRIES, RUNS
from weftwork.plans import graph as G
from weftwork.plans import history as H
from weftwork.session import stage

c = F.col
_R = f"({duck(RUNS)})"
_E = f"({duck(ENTRIES)})"
_DAY = "2024-01-15"
_SECS = (r"CASE WHEN regexp_full_match(avg_job_duration_in_mins_sec, '(\d+)m (\d+)sec') THEN "
         r"CAST(split_part(avg_job_duration_in_mins_sec, 'm', 1) AS INT) * 60 + "
         r"CAST(replace(split_part(avg_job_duration_in_mins_sec, ' ', 2), 'sec', '') AS INT) END")


def _rank(p: int, v: str = "v") -> str:
    return f"max(CASE WHEN k = greatest(1, least(n, CAST(ceil({p} / 100.0::DOUBLE * n) AS BIGINT))) THEN {v} END)"


@query("snapshot_dates", "SELECT DISTINCT CAST(ts AS DATE) AS run_date FROM events")
def snapshot_dates(t):
    return H.snapshot_dates(nested.runs(t))


@query("snapshot", f"SELECT recipe_filename, status, job_id FROM {_R} r WHERE run_date = DATE '{_DAY}'")
def snapshot(t):
    return H.snapshot(nested.runs(t), _DAY).select("recipe_filename", "status", "job_id")


@query("nearest_date", """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error' AND value > 300),
req AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS r FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events),
solved AS (SELECT r, arg_min(d, (abs(date_diff('day', d, r)), d)) AS nearest FROM req LEFT JOIN days ON true GROUP BY r)
SELECT o_orderkey AS id, r AS requested, nearest FROM orders JOIN solved ON CAST(o_orderdate AS DATE) = r
UNION ALL SELECT event_id, r, nearest FROM events JOIN solved ON CAST(ts AS DATE) = r""")
def nearest_date(t):
    available = t.events.filter("event_type = 'error' AND value > 300").select(F.to_date("ts").alias("run_date"))
    requests = t.orders.select(c("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("requested")).union(
        t.events.select("event_id", F.to_date("ts")))
    return H.nearest_date(requests, available).select("id", "requested", "nearest")


@query("nearest_date_all", """
WITH days AS (SELECT DISTINCT CASE WHEN day(ts) % 3 = 0 THEN CAST(ts AS DATE) - 400 ELSE CAST(ts AS DATE) END AS d FROM events),
req AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS r FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events),
solved AS (SELECT r, arg_min(d, (abs(date_diff('day', d, r)), d)) AS nearest FROM req LEFT JOIN days ON true GROUP BY r)
SELECT o_orderkey AS id, r AS requested, nearest FROM orders JOIN solved ON CAST(o_orderdate AS DATE) = r
UNION ALL SELECT event_id, r, nearest FROM events JOIN solved ON CAST(ts AS DATE) = r""")
def nearest_date_all(t):
    """`nearest_date` over the dates of all events; each third day is shifted away, which leaves gaps and ties."""
    day = F.to_date("ts")
    available = t.events.select(F.when(F.dayofmonth("ts") % 3 == 0, F.date_sub(day, 400)).otherwise(day).alias("run_date"))
    requests = t.orders.select(c("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("requested")).union(
        t.events.select("event_id", day))
    return H.nearest_date(requests, available).select("id", "requested", "nearest")


_ROLLUP = f"""
WITH r AS (SELECT *, {_SECS} / 60.0::DOUBLE AS v FROM {_R} q),
ranked AS (SELECT recipe_filename, v, row_number() OVER (PARTITION BY recipe_filename ORDER BY v) AS k,
  count(*) OVER (PARTITION BY recipe_filename) AS n FROM r WHERE v IS NOT NULL),
pct AS (SELECT recipe_filename, {_rank(50)} AS p50_min, {_rank(95)} AS p95_min FROM ranked GROUP BY 1),
base AS (SELECT recipe_filename, max(run_date) AS latest_date, arg_max(status, run_date) AS latest_status, arg_max(job_id, run_date) AS last_job_id,
  arg_max(cluster_name, run_date) AS last_cluster, count(*) FILTER (WHERE status = 'SUCCESS') AS ok, count(*) FILTER (WHERE status = 'FAILED') AS ko,
  avg(v) AS avg_min, string_agg(status, ',' ORDER BY run_date) AS strip FROM r GROUP BY 1),
rollup_ AS (SELECT b.*, p50_min, p95_min, coalesce(layer, 'UNKNOWN') AS layer FROM base b LEFT JOIN pct USING (recipe_filename)
  LEFT JOIN (SELECT recipe, layer FROM {_E} e) l ON recipe_filename = recipe)"""


_ROLLUP_SQL = _ROLLUP + """
SELECT recipe_filename, layer, latest_date, latest_status, ok, ko, strip, round(avg_min, 5) AS avg_min, round(p50_min, 5) AS p50_min,
  round(p95_min, 5) AS p95_min, last_job_id, last_cluster FROM rollup_"""


def _stripped(out):
    return out.withColumn("strip", F.array_join(F.transform("history", lambda h: h["status"]), ",")).drop("history").withColumns(
        {n: F.round(n, 5) for n in ("avg_min", "p50_min", "p95_min")})


@query("recipe_rollup", _ROLLUP_SQL)
def recipe_rollup(t):
    return _stripped(H.recipe_rollup(nested.runs(t), nested.entries(t)))


def _state_day_by_day(t):
    """The state of all runs up to three days before the last, kept, and then each further day added to what is kept."""
    runs = nested.runs(t)
    last = runs.agg(F.max("run_date")).first()[0]
    if last is None:
        return H.history_state(runs)
    days = [last - timedelta(n) for n in (2, 1, 0)]
    state = stage(H.history_state(runs.filter(c("run_date").isNull() | (c("run_date") < F.lit(days[0])))), "history")
    for day in days:
        state = stage(H.merge_states(state, H.history_state(H.snapshot(runs, str(day)))), "history")
    return state


@query("recipe_rollup_incremental", _ROLLUP_SQL)
def recipe_rollup_incremental(t):
    return _stripped(H.rollup_of_state(_state_day_by_day(t), nested.entries(t)))


_STATE = "CASE {0} WHEN 'SUCCESS' THEN 'OK' WHEN 'FAILED' THEN 'KO' ELSE 'PENDING' END"


@query("status_at_date", _ROLLUP + f"""
SELECT b.recipe_filename, {_STATE.format('r.status')} AS state, {_STATE.format('b.latest_status')} AS latest_state
FROM base b LEFT JOIN r ON r.recipe_filename = b.recipe_filename AND r.run_date = DATE '{_DAY}'""")
def status_at_date(t):
    rollup = H.recipe_rollup(nested.runs(t), nested.entries(t))
    return H.status_at(rollup, _DAY).join(H.status_at(rollup).withColumnRenamed("state", "latest_state"), "recipe_filename")


@query("table_status", _ROLLUP + f"""
SELECT 'table:' || target AS "table", CASE WHEN bool_or(st = 'KO') THEN 'KO' WHEN bool_or(st = 'OK') THEN 'OK' ELSE 'PENDING' END AS state,
  min(recipe) AS first_writer, round(arg_min(avg_min, recipe), 5) AS avg_min
FROM (SELECT target, recipe, coalesce(avg_min, -1) AS avg_min, {_STATE.format('latest_status')} AS st FROM {_E} e LEFT JOIN base ON recipe_filename = recipe) x
GROUP BY target""")
def table_status(t):
    rollup = H.recipe_rollup(nested.runs(t), nested.entries(t))
    edges = G.graph_edges(nested.entries(t))
    out = H.table_status(edges, H.status_at(rollup), rollup)
    return out.select("table", "state", "first_writer", F.round(F.coalesce("avg_min", F.lit(-1.0)), 5).alias("avg_min"))


@query("snapshot_summary", f"""
SELECT count(*) AS rows, count(DISTINCT recipe_filename) AS recipes,
  (SELECT count(DISTINCT target) FROM {_E} e WHERE recipe IN (SELECT recipe_filename FROM {_R} r WHERE run_date = DATE '{_DAY}')) AS tables,
  count(*) FILTER (WHERE status = 'SUCCESS') AS ok, count(*) FILTER (WHERE status = 'FAILED') AS ko
FROM {_R} r WHERE run_date = DATE '{_DAY}'""")
def snapshot_summary(t):
    return H.snapshot_summary(nested.runs(t), G.graph_edges(nested.entries(t)), _DAY)


@query("workflow_run", f"""
WITH m AS (SELECT DISTINCT CASE WHEN trim(workflow) = '' THEN 'UNGROUPED' ELSE trim(workflow) END AS workflow, recipe FROM {_E} e),
d AS (SELECT DISTINCT run_date FROM {_R} r),
x AS (SELECT workflow, run_date, bool_or(status = 'FAILED') AS bad, bool_or(status = 'SUCCESS') AS good, max(app_start_iso) AS started_at,
  sum(coalesce({_SECS}, 0)) AS duration_s FROM {_R} r JOIN m ON recipe = recipe_filename GROUP BY 1, 2)
SELECT w.workflow, d.run_date, CASE WHEN bad THEN 'failed' WHEN good THEN 'success' ELSE 'skipped' END AS status,
  coalesce(started_at, '') AS started_at, CAST(coalesce(duration_s, 0) AS BIGINT) AS duration_s
FROM (SELECT DISTINCT workflow FROM m) w CROSS JOIN d LEFT JOIN x ON x.workflow = w.workflow AND x.run_date = d.run_date""")
def workflow_run(t):
    clusters = G.clusters(G.graph_nodes(nested.entries(t), _no_paths(t)))
    return H.workflow_runs(nested.runs(t), clusters)


def _no_paths(t):
    return nested.entries(t).select("recipe", F.concat_ws("/", "mapping_xml_dir", "recipe").alias("path"))


_TASKS_SQL = f"""
WITH m AS (SELECT DISTINCT recipe FROM {_E} e), r AS (SELECT *, {_SECS} AS v FROM {_R} q), d AS (SELECT DISTINCT run_date FROM r),
ranked AS (SELECT recipe_filename, v, row_number() OVER (PARTITION BY recipe_filename ORDER BY v) AS k,
  count(*) OVER (PARTITION BY recipe_filename) AS n FROM r WHERE v > 0),
pct AS (SELECT recipe_filename, floor(avg(v) + 0.5) AS avg_time_s, {_rank(50)} AS p50, {_rank(95)} AS p95, {_rank(99)} AS p99 FROM ranked GROUP BY 1),
strips AS (SELECT recipe, string_agg({_STATE.format('status')}, ',' ORDER BY d.run_date) AS strip
  FROM m CROSS JOIN d LEFT JOIN r ON recipe_filename = recipe AND r.run_date = d.run_date GROUP BY 1)
SELECT recipe AS recipe_filename, CAST(coalesce(avg_time_s, 0) AS BIGINT) AS avg_time_s, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95,
  coalesce(p99, 0) AS p99, strip FROM strips LEFT JOIN pct ON recipe_filename = recipe"""


@query("task_stats", _TASKS_SQL)
def task_stats(t):
    out = H.task_stats(nested.runs(t), nested.entries(t).select("recipe"))
    return out.withColumn("strip", F.array_join("history", ",")).drop("history")


@query("task_stats_incremental", _TASKS_SQL)
def task_stats_incremental(t):
    out = H.task_stats_of_state(_state_day_by_day(t), nested.entries(t).select("recipe"))
    return out.withColumn("strip", F.array_join("history", ",")).drop("history")


@query("load_order", f"""
SELECT recipe, layer, CASE layer WHEN 'STG' THEN 0 WHEN 'ODS' THEN 1 WHEN 'DWH' THEN 2 WHEN 'CDM' THEN 3 WHEN 'RDM' THEN 4 WHEN 'QDM' THEN 5
  WHEN 'ETL' THEN 6 ELSE 7 END AS layer_rank, execution_order FROM {_E} e""")
def load_order(t):
    return H.load_order(nested.entries(t))
