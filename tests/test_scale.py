"""Plans that must hold at a thousand times the data."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftwork.operators import joins, lookups

ROOT = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_pairwise_join_and_no_row_at_a_time_python(spark, name):
    text = plan(entry.queries()[name](spark, ROOT))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)


def test_filter_and_columns_reach_the_scan(spark):
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan(entry.queries()["source_filter"](spark, ROOT))).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "In(o_orderstatus, [F,P])" in pushed
    scan = plan(entry.queries()["segment_revenue"](spark, ROOT))
    assert "struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in scan


@pytest.fixture
def small_partitions(spark):
    """Thresholds that make a few megabytes look like a skewed cluster join."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark):
    """A third of the rows share one key."""
    return spark.range(0, 300000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id")


@pytest.mark.parametrize("case", ["lookup", "full_outer", "not_in", "only_new"])
def test_hot_key_is_split(spark, small_partitions, case):
    table = spark.range(1, 5001).select(F.col("id").alias("tk"), (F.col("id") * 2).alias("v"))
    out = {"lookup": lambda: lookups.lookup(hot(spark), table, [("k", "tk")], {"v": "v"}, "First", ["v"]),
           "full_outer": lambda: joins.joiner(hot(spark), table, [("k", "=", "tk")], joins.FULL_OUTER),
           "not_in": lambda: joins.not_in(hot(spark), "k", table.filter("tk > 10"), "tk"),
           "only_new": lambda: lookups.only_new(hot(spark), table.filter("tk > 10"), [("k", "tk")])}[case]()
    out.collect()
    assert "skew=true" in plan(out)
