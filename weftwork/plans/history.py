"""Operational analytics over job-history runs.

Runs: (recipe_filename, run_date, avg_job_duration_in_mins_sec, status, job_id,
cluster_name, app_start_iso), one row a recipe and day, as the daily snapshots
hold them. Dates are calendar days, so a recipe's history, like the set of
distinct dates, is bounded by the calendar and may travel as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.dates import duration_seconds, parse_duration
from weftwork.operators.windows import first_by

# Display rank of a layer.
LAYER_RANK = {"STG": 0, "ODS": 1, "DWH": 2, "CDM": 3, "RDM": 4, "QDM": 5, "ETL": 6, "OUTPUT": 7, "UNKNOWN": 8}


def snapshot_dates(runs: DataFrame) -> DataFrame:
    return runs.select("run_date").distinct().orderBy("run_date")


def snapshot(runs: DataFrame, date: str) -> DataFrame:
    return runs.filter(F.col("run_date") == F.lit(date).cast("date"))


def _all_dates(runs: DataFrame) -> Column:
    """Sorted array of the distinct dates, as a scalar sub-query."""
    return runs.agg(F.array_sort(F.collect_set("run_date")).alias("d")).scalar()


def nearest_date(requests: DataFrame, dates: DataFrame, requested: str = "requested") -> DataFrame:
    """Nearest available date of each requested one; a tie takes the earlier.

    Solved once for each distinct requested day, then joined back by day.
    """
    distance = lambda d: F.struct(F.abs(F.date_diff(d, F.col(requested))).alias("dist"), d.alias("nearest"))
    solved = (requests.select(requested).distinct().withColumn("_days", _all_dates(dates))
              .withColumn("nearest", F.array_min(F.transform("_days", distance))["nearest"]).drop("_days"))
    return requests.join(solved, requested, "left")


def _nearest_ranks(runs: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """(recipe_filename, one column a wanted percentile, ``mean``) from counts of distinct values, which durations keep few.

    Equal values of a recipe collapse to a count before they meet, so an array is bounded by the distinct durations however many runs there are.
    """
    counts = runs.filter(F.col(value).isNotNull()).groupBy("recipe_filename", value).agg(F.count("*").alias("n"))
    lists = counts.groupBy("recipe_filename").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias("vs"),
                                                  F.sum("n").alias("total"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"))

    return lists.select("recipe_filename", "mean", *[_at_rank(p, dict(runs.dtypes)[value]).alias(n) for n, p in wanted.items()])


def _at_rank(p: float, kind: str) -> Column:
    """Nearest-rank percentile over ``vs``, sorted (v, n) pairs with ``total`` values."""
    rank = F.greatest(F.lit(1), F.ceil(F.lit(p / 100.0) * F.col("total")))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(kind).alias("v"))
    step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["seen"] < rank, x["v"]).otherwise(acc["v"]).alias("v"))
    return F.aggregate("vs", start, step)["v"]


def recipe_rollup(runs: DataFrame, entries: DataFrame, order: str = "entry_order") -> DataFrame:
    """Per recipe: layer, latest run, ok/ko, history, avg/p50/p95 minutes.

    ``history`` has one entry a day: of several runs of a day the one with the largest job id.
    """
    timed = runs.withColumn("minutes", parse_duration(F.col("avg_job_duration_in_mins_sec")))
    daily = timed.groupBy("recipe_filename", "run_date").agg(
        F.max_by(F.struct("status", "minutes", "job_id", "cluster_name"), F.coalesce("job_id", F.lit(""))).alias("d"),
        F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.count_if(F.col("status") == "FAILED").alias("ko"))
    base = daily.groupBy("recipe_filename").agg(
        F.max_by(F.struct("run_date", "d"), "run_date").alias("l"), F.sum("ok").alias("ok"), F.sum("ko").alias("ko"),
        F.array_sort(F.collect_list(F.struct("run_date", F.col("d.status").alias("status"), F.col("d.minutes").alias("minutes")))).alias("history"))
    ranks = _nearest_ranks(timed, "minutes", {"p50_min": 50, "p95_min": 95}).withColumnRenamed("mean", "avg_min")
    layers = first_by(entries, ["recipe"], ["layer"], [order]).withColumnRenamed("recipe", "recipe_filename")
    return (base.join(ranks, "recipe_filename", "left").join(layers, "recipe_filename", "left")
            .select("recipe_filename", F.coalesce("layer", F.lit("UNKNOWN")).alias("layer"),
                    F.col("l.run_date").alias("latest_date"), F.col("l.d.status").alias("latest_status"),
                    "ok", "ko", "history", "avg_min", "p50_min", "p95_min",
                    F.col("l.d.job_id").alias("last_job_id"), F.col("l.d.cluster_name").alias("last_cluster")))


def display_status(status: Column) -> Column:
    return F.when(status == "SUCCESS", "OK").when(status == "FAILED", "KO").otherwise("PENDING")


def status_at(rollup: DataFrame, date: str | None = None) -> DataFrame:
    """(recipe_filename, state) on exactly ``date`` (nothing is carried forward), or latest without a date."""
    if date is None:
        status = F.col("latest_status")
    else:
        day = F.lit(date).cast("date")
        status = F.get(F.filter("history", lambda h: h["run_date"] == day), F.lit(0))["status"]
    return rollup.select("recipe_filename", display_status(status).alias("state"))


def table_status(edges: DataFrame, status: DataFrame, rollup: DataFrame) -> DataFrame:
    """State of each written table from all its writers; statistics from its first writer by name."""
    writes = edges.filter(F.col("kind") == "writes").select(
        F.col("to").alias("table"), F.regexp_replace("from", "^recipe:", "").alias("recipe_filename"))
    known = writes.join(status, "recipe_filename", "left").join(
        rollup.select("recipe_filename", "avg_min", "p50_min", "p95_min"), "recipe_filename", "left")
    rank = F.when(F.col("state") == "KO", 2).when(F.col("state") == "OK", 1).otherwise(0)
    worst = known.groupBy("table").agg(
        F.max(rank).alias("r"),
        F.min_by(F.struct("recipe_filename", "avg_min", "p50_min", "p95_min"), "recipe_filename").alias("f"))
    return worst.select("table", F.when(F.col("r") == 2, "KO").when(F.col("r") == 1, "OK").otherwise("PENDING").alias("state"),
                        F.col("f.recipe_filename").alias("first_writer"), F.col("f.avg_min").alias("avg_min"),
                        F.col("f.p50_min").alias("p50_min"), F.col("f.p95_min").alias("p95_min"))


def snapshot_summary(runs: DataFrame, edges: DataFrame, date: str) -> DataFrame:
    """One row: rows, recipes, written tables, ok and ko of a date."""
    day = snapshot(runs, date)
    head = day.agg(F.count("*").alias("rows"), F.count_distinct("recipe_filename").alias("recipes"),
                   F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.count_if(F.col("status") == "FAILED").alias("ko"))
    writes = edges.filter(F.col("kind") == "writes").select(
        F.col("to").alias("t"), F.regexp_replace("from", "^recipe:", "").alias("recipe_filename"))
    tables = writes.join(day, "recipe_filename", "left_semi").agg(F.count_distinct("t").alias("n")).scalar()
    return head.select("rows", "recipes", tables.alias("tables"), "ok", "ko")


def run_state(status: Column) -> Column:
    s = F.upper(F.trim(status))
    return F.when(s == "SUCCESS", "success").when(s == "FAILED", "failed").when(s == "RUNNING", "running").otherwise("skipped")


def workflow_runs(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(workflow, run_date, status, started_at, duration_s) for every workflow on every date, gaps included."""
    daily = (runs.join(clusters.withColumnRenamed("recipe", "recipe_filename"), "recipe_filename")
             .groupBy("workflow", "run_date").agg(
                 F.bool_or(run_state(F.col("status")) == "failed").alias("bad"),
                 F.bool_or(run_state(F.col("status")).isin("success", "running")).alias("good"),
                 F.max(F.coalesce("app_start_iso", F.lit(""))).alias("started_at"),
                 F.sum(F.coalesce(duration_seconds(F.col("avg_job_duration_in_mins_sec")), F.lit(0))).alias("duration_s")))
    grid = clusters.select("workflow").distinct().withColumn("run_date", F.explode(_all_dates(runs)))
    return grid.join(daily, ["workflow", "run_date"], "left").select(
        "workflow", "run_date", F.when(F.col("bad"), "failed").when(F.col("good"), "success").otherwise("skipped").alias("status"),
        F.coalesce("started_at", F.lit("")).alias("started_at"), F.coalesce("duration_s", F.lit(0)).alias("duration_s"))


def task_stats(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task: avg (rounded), p50, p95, p99 seconds over durations above 0, and its state on every date.

    The history is filled from the dates array, one state a date, PENDING where the task has no run. Of several runs of a day
    the one with the largest job id counts, as in ``recipe_rollup``; a run without job id counts where there is no other, one without date in no day.
    """
    timed = runs.withColumn("seconds", duration_seconds(F.col("avg_job_duration_in_mins_sec")))
    ran = timed.filter(F.col("seconds") > 0)
    ranks = _nearest_ranks(ran, "seconds", {"p50": 50, "p95": 95, "p99": 99}).withColumn("avg_time_s", F.floor(F.col("mean") + 0.5)).drop("mean")
    state = F.when(run_state(F.col("status")) == "running", "RUNNING").otherwise(display_status(F.upper(F.trim("status"))))
    daily = runs.filter(F.col("run_date").isNotNull()).groupBy("recipe_filename", "run_date").agg(F.max_by(state, F.coalesce("job_id", F.lit(""))).alias("state"))
    known = daily.groupBy("recipe_filename").agg(F.map_from_entries(F.collect_list(F.struct("run_date", "state"))).alias("by_day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (tasks.select(F.col("recipe").alias("recipe_filename")).distinct().withColumn("_days", _all_dates(runs))
            .join(known, "recipe_filename", "left").join(ranks, "recipe_filename", "left")
            .select("recipe_filename", zero("avg_time_s"), zero("p50"), zero("p95"), zero("p99"),
                    F.transform("_days", lambda d: F.coalesce(F.try_element_at(F.col("by_day"), d), F.lit("PENDING"))).alias("history")))


def layer_rank(layer: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in LAYER_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, layer), F.lit(LAYER_RANK["UNKNOWN"]))


def load_order(entries: DataFrame) -> DataFrame:
    """Recipes by layer rank, execution order and name; a parallel range sort."""
    rank = layer_rank(F.col("layer")).alias("layer_rank")
    return entries.select("recipe", "layer", rank, "execution_order").distinct().orderBy("layer_rank", "execution_order", "recipe")


def history_state(runs: DataFrame) -> DataFrame:
    """What rollups need of ``runs``, one row a recipe: ok, ko, ``days`` (date → the day's run that counts), ``undated`` (the same
    of runs without date), ``durations`` (duration text → count). Bounded by the calendar and the distinct durations, however many runs there are.

    Keep it, and bring it up to date with ``merge_states``: a new day costs its own runs and one row a recipe, not the history.
    """
    key = ["recipe_filename"]
    run = F.struct(F.coalesce("job_id", F.lit("")).alias("rank"), "status", parse_duration(F.col("avg_job_duration_in_mins_sec")).alias("minutes"), "job_id", "cluster_name")
    daily = runs.groupBy(*key, "run_date").agg(F.max(run).alias("run"), F.count_if(F.col("status") == "SUCCESS").alias("ok"),
                                               F.count_if(F.col("status") == "FAILED").alias("ko"))
    days = daily.groupBy(*key).agg(
        F.sum("ok").alias("ok"), F.sum("ko").alias("ko"),
        F.map_from_entries(F.collect_list(F.when(F.col("run_date").isNotNull(), F.struct("run_date", "run")))).alias("days"),
        F.max(F.when(F.col("run_date").isNull(), F.col("run"))).alias("undated"))
    text = F.col("avg_job_duration_in_mins_sec").alias("text")
    durations = (runs.groupBy(*key, text).agg(F.count("*").alias("n")).groupBy(*key)
                 .agg(F.map_from_entries(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("text", "n")))).alias("durations")))
    # A recipe without a name is a recipe too, so keys meet null-safe.
    named = durations.withColumnRenamed("recipe_filename", "_name")
    return days.join(named, days["recipe_filename"].eqNullSafe(named["_name"])).drop("_name")


def merge_states(state: DataFrame, added: DataFrame) -> DataFrame:
    """The state of both sets of runs. Each run must be in one of them only; days may overlap, and order does not matter."""
    a, b = state.alias("a"), added.alias("b")
    joined = a.join(b, F.col("a.recipe_filename").eqNullSafe(F.col("b.recipe_filename")), "full")
    total = lambda n: (F.coalesce(f"a.{n}", F.lit(0)) + F.coalesce(f"b.{n}", F.lit(0))).alias(n)

    def both(n: str, merge) -> Column:
        return F.coalesce(F.map_zip_with(f"a.{n}", f"b.{n}", lambda _, x, y: merge(x, y)), f"a.{n}", f"b.{n}").alias(n)

    count = lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    # ``greatest`` does not order structs; the larger of an array of two is the same and skips NULLs.
    return joined.select(F.coalesce("a.recipe_filename", "b.recipe_filename").alias("recipe_filename"), total("ok"), total("ko"),
                         both("days", lambda x, y: F.array_max(F.array(x, y))),
                         F.array_max(F.array("a.undated", "b.undated")).alias("undated"), both("durations", count))


def _with_lists(state: DataFrame, value) -> DataFrame:
    """``state`` with ``vs``, ``total`` and ``mean`` of ``value(duration text)`` for ``_at_rank``."""
    pairs = F.transform(F.map_entries("durations"), lambda e: F.struct(value(e["key"]).alias("v"), e["value"].alias("n")))
    return (state.withColumn("vs", F.array_sort(F.filter(pairs, lambda x: x["v"].isNotNull())))
            .withColumn("total", F.aggregate("vs", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]))
            .withColumn("mean", F.try_divide(F.aggregate("vs", F.lit(0.0), lambda acc, x: acc + x["v"] * x["n"]), F.col("total"))))


def rollup_of_state(state: DataFrame, entries: DataFrame, order: str = "entry_order") -> DataFrame:
    """``recipe_rollup`` of the runs behind ``state``."""
    rows = _with_lists(state, parse_duration)
    entry = lambda day, run: F.struct(day.alias("run_date"), run["status"].alias("status"), run["minutes"].alias("minutes"))
    dated = F.transform(F.map_entries("days"), lambda e: entry(e["key"], e["value"]))
    undated = F.when(F.col("undated").isNotNull(), F.array(entry(F.lit(None).cast("date"), F.col("undated")))).otherwise(F.array())
    latest = F.array_max(F.map_keys("days"))
    layers = first_by(entries, ["recipe"], ["layer"], [order]).withColumnRenamed("recipe", "recipe_filename")
    rows = rows.withColumn("latest_date", latest).withColumn("l", F.try_element_at("days", F.col("latest_date")))
    return (rows.join(layers, "recipe_filename", "left")
            .select("recipe_filename", F.coalesce("layer", F.lit("UNKNOWN")).alias("layer"), "latest_date", F.col("l.status").alias("latest_status"),
                    "ok", "ko", F.array_sort(F.concat(dated, undated)).alias("history"), F.col("mean").alias("avg_min"),
                    _at_rank(50, "double").alias("p50_min"), _at_rank(95, "double").alias("p95_min"),
                    F.col("l.job_id").alias("last_job_id"), F.col("l.cluster_name").alias("last_cluster")))


def task_stats_of_state(state: DataFrame, tasks: DataFrame) -> DataFrame:
    """``task_stats`` of the runs behind ``state``."""
    positive = lambda text: F.when(duration_seconds(text) > 0, duration_seconds(text))
    dates = state.select(F.explode(F.map_keys("days")).alias("run_date"))
    ranks = [_at_rank(p, "bigint").alias(f"p{p}") for p in (50, 95, 99)]
    known = _with_lists(state, positive).select("recipe_filename", "days", F.floor(F.col("mean") + 0.5).alias("avg_time_s"), *ranks)
    shown = lambda run: F.when(run.isNull(), "PENDING").when(run_state(run["status"]) == "running", "RUNNING").otherwise(display_status(F.upper(F.trim(run["status"]))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (tasks.select(F.col("recipe").alias("recipe_filename")).distinct().withColumn("_days", _all_dates(dates)).join(known, "recipe_filename", "left")
            .select("recipe_filename", zero("avg_time_s"), zero("p50"), zero("p95"), zero("p99"),
                    F.transform("_days", lambda d: shown(F.try_element_at(F.col("days"), d))).alias("history")))
