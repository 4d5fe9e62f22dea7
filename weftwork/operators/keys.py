"""Dense row numbers without a one-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def dense_index(df: DataFrame, order_by: list[str | Column], name: str, start: int = 1, step: int = 1, pin: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Add ``name`` = start, start+step, … in the order of ``order_by`` (unique, so ties cannot pile up).

    Rows are range-partitioned and sorted in parallel, written once to the
    checkpoint folder so the numbering survives lost executors, and each
    partition then adds the number of rows before it. The offset table has one
    row a partition, so its one-task running sum and its broadcast are bounded by
    the partition count whatever the data size. ``pin`` writes the numbered rows; a checkpoint takes
    rows of any type, Parquet takes far less room.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    placed = pin(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_place", F.monotonically_increasing_id()))
    placed = (placed.withColumn("_part", F.shiftright("_place", _ROW_BITS))
              .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    number = F.lit(start) + (F.col("_offset") + F.col("_row")) * F.lit(step)
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, number.cast("bigint")).drop("_place", "_part", "_row", "_offset"))


def sequence(df: DataFrame, order_by: list[str | Column], name: str = "NEXTVAL", start: int = 1, step: int = 1) -> DataFrame:
    """Sequence generator: NEXTVAL surrogate key."""
    return dense_index(df, order_by, name, start, step)
