"""The kept state of a history: runs added in any portions give what one pass over all of them gives."""

import datetime
import random

import pytest

from weftwork.plans import history as H

RUN = "recipe_filename string, run_date date, avg_job_duration_in_mins_sec string, status string, job_id string, cluster_name string, app_start_iso string"


def some_runs(n):
    rnd, day = random.Random(n), lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)
    return [(rnd.choice(["a", "b", "c", "d"]), day(rnd.randint(0, 9)) if rnd.random() > 0.05 else None,
             rnd.choice(["3m 5sec", "0m 0sec", "12m 1sec", "1m 59sec", "odd", None]), rnd.choice(["SUCCESS", "FAILED", "RUNNING", " success ", None]),
             f"j{i:04d}" if rnd.random() > 0.02 else None, "k", None) for i in range(n)]


def flat(df):
    number = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(number(v) if not isinstance(v, list) else str(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("order", ["by day", "dealt out"])
def test_portions_equal_the_whole(spark, order):
    runs = some_runs(120)
    runs = [r for i, r in enumerate(runs) if r[4] is not None or not any(x[:2] == r[:2] and x[4] is None for x in runs[:i])]  # ties have no order
    portion = (lambda r, i: str(r[1])) if order == "by day" else (lambda r, i: i % 3)
    portions = {}
    for i, r in enumerate(runs):
        portions.setdefault(portion(r, i), []).append(r)
    state = H.history_state(spark.createDataFrame([], RUN))
    for _, part in sorted(portions.items(), key=lambda p: str(p[0])):
        state = H.merge_states(state, H.history_state(spark.createDataFrame(part, RUN))).checkpoint()
    whole = spark.createDataFrame(runs, RUN)
    entries = spark.createDataFrame([("a", "STG", 1), ("b", "DWH", 2), ("z", "CDM", 3)], "recipe string, layer string, entry_order int")
    want = H.recipe_rollup(whole, entries)
    assert flat(H.rollup_of_state(state, entries).select(*want.columns)) == flat(want)
    tasks = H.task_stats(whole, entries)
    assert flat(H.task_stats_of_state(state, entries).select(*tasks.columns)) == flat(tasks)


def test_an_empty_history(spark):
    state = H.history_state(spark.createDataFrame([], RUN))
    assert H.merge_states(state, state).count() == 0
    entries = spark.createDataFrame([("a", "STG", 1)], "recipe string, layer string, entry_order int")
    assert H.rollup_of_state(state, entries).count() == 0
    assert [tuple(r) for r in H.task_stats_of_state(state, entries).collect()] == [("a", 0, 0, 0, 0, [])]
