"""Aggregations; every one is partial before the shuffle, so a hot key arrives already reduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import cut


def aggregate(df: DataFrame, keys: list[str], exprs: dict[str, Column], last: list[str] | None = None,
              order_by: list[str] | None = None) -> DataFrame:
    """GROUP BY; no keys gives one row.

    ``last`` lists output ports that are neither grouped nor aggregated: they
    take the group's last row in the order of ``order_by``.
    """
    aggs = [e.alias(n) for n, e in exprs.items()]
    if last:
        if not order_by:
            raise ValueError("a pass-through port needs order_by")
        aggs.append(F.max_by(F.struct(*last), F.struct(*order_by)).alias("_last"))
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if not last:
        return out
    return out.select(*keys, *exprs, *[F.col(f"_last.{c}").alias(c) for c in last])


def sum_(x: Column, where: Column | None = None) -> Column:
    return F.sum(x if where is None else F.when(where, x))


def count_(x: Column | None = None, where: Column | None = None) -> Column:
    x = F.lit(1) if x is None else x
    return F.count(x if where is None else F.when(where, x))


def max_(x: Column, where: Column | None = None) -> Column:
    return F.max(x if where is None else F.when(where, x))


def min_(x: Column, where: Column | None = None) -> Column:
    return F.min(x if where is None else F.when(where, x))


def avg_(x: Column, where: Column | None = None) -> Column:
    return F.avg(x if where is None else F.when(where, x))


def status_counts(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """``ok`` and ``ko`` rows; other statuses count in neither."""
    return df.groupBy(*keys).agg(F.count_if(F.col(status) == "SUCCESS").alias("ok"),
                                 F.count_if(F.col(status) == "FAILED").alias("ko"))


def percentile_nearest_rank(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact ``ceil(p/100·n)``-th smallest value of each group, clamped to [1, n]; NULLs ignored, none → no row.

    A group may hold most of the table, so it is never sorted as one. A mergeable quantile sketch of the rows places
    cut points just around each wanted rank; equal values collapse to counts, and exact counts between the cuts tell
    which narrow band, some thousandths of the rows, holds the rank. Only that band is ordered: its values are
    range-partitioned, and each partition adds the rows of those before it. The sketch
    decides how narrow the bands are, never the answer.
    """
    # One struct as the key: it is never NULL, so groups with a NULL key survive the joins.
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    counts = (df.filter(F.col(value).isNotNull()).groupBy(key.alias("_k"), F.col(value).alias("_v"))
              .agg(F.count("*").alias("_n")))
    margin = 2e-4
    probes = sorted({min(max(p / 100 + d, 0.0), 1.0) for p in wanted.values() for d in (-margin, margin)})
    cuts = (df.filter(F.col(value).isNotNull()).groupBy(key.alias("_k"))
            .agg(F.percentile_approx(F.col(value), probes, 10000).alias("_cuts"), F.count("*").alias("_total")))
    banded = counts.join(cuts, "_k").withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    bands = banded.groupBy("_k", "_band").agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_total"))
    upto = F.sum("_bn").over(Window.partitionBy("_k").orderBy("_band"))  # one row a band: a handful a key
    bands = bands.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_bn"))
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.least(
        F.col("_total"), F.ceil(F.lit(p / 100.0) * F.col("_total")))).alias("rank")) for n, p in wanted.items()])
    targets = (bands.withColumn("_t", F.explode(ranks))
               .filter((F.col("_before") < F.col("_t.rank")) & (F.col("_t.rank") <= F.col("_upto")))
               .select("_k", "_band", "_before", F.col("_t.name").alias("_name"), F.col("_t.rank").alias("_rank")))
    inside = banded.select("_k", "_band", "_v", "_n").join(targets, ["_k", "_band"])
    spread = ["_k", "_name", "_v"]
    placed = cut(inside.repartitionByRange(*spread).sortWithinPartitions(*spread).withColumn("_part", F.spark_partition_id()))
    upto_part = Window.partitionBy("_k", "_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    ahead = (placed.groupBy("_k", "_name", "_part").agg(F.sum("_n").alias("_pn"))
             .select("_k", "_name", "_part", F.coalesce(F.sum("_pn").over(upto_part), F.lit(0)).alias("_ahead")))
    in_part = F.sum("_n").over(Window.partitionBy("_k", "_name", "_part").orderBy("_v"))
    found = (placed.withColumn("_here", in_part).join(ahead, ["_k", "_name", "_part"])
             .filter(F.col("_before") + F.col("_ahead") + F.col("_here") >= F.col("_rank")))
    out = found.groupBy("_k").agg(*[F.min(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in wanted])
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *wanted)
