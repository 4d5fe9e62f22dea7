"""What the operators of this package share: staged tables, free column names, ordered running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.session import stage, tune

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

# Python workers get batches of bounded bytes, so a run of very long texts fits in memory. A batch is held several times at once, outside the
# heap of the JVM (as vectors that double and as the stream written to the worker) and in the worker, and freed memory of this size stays with both.
BATCH_BYTES = 4 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, root)`` under ``name``, with the SQL that gives the same rows where there is one."""
    def add(fn):
        QUERIES[name] = lambda spark, root: fn(ready(spark), root)
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def ready(spark: SparkSession) -> SparkSession:
    """The session settings of the library, and bounded batches for Python workers."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process, for what tasks on one worker can share."""
    import sys
    import types

    return vars(sys.modules.setdefault("_weftwork_process", types.ModuleType("_weftwork_process")))


def stream_udf(fn, returns: str, frame: bool = False):
    """A pandas function over an iterator of batches of one column, so that it can prepare once a task; ``frame``: it yields structs."""
    from collections.abc import Iterator

    import pandas as pd

    fn.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame if frame else pd.Series]}
    return F.pandas_udf(fn, returns)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` staged with a unique number a row (not dense)."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE))).otherwise(0).cast("bigint")


def source_key(source: Column) -> Column:
    """A source as a string that is never NULL and sorts NULL behind all others."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def ordered_totals(df: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """Add for each ``{name: measure}`` the sum of ``measure`` over the rows before this one, inside ``group``.

    ``order`` must tell rows apart. Rows are range-partitioned over all tasks by group
    and order, so a hot group spans many of them; each task sums what it holds,
    and the sums of the partitions before it are added from a table of one row a
    partition and group.
    """
    keys = [group] if group else []
    by = [F.col(c) for c in keys + order]
    placed = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "order")
    placed = placed.withColumn("_part", F.shiftright("_place", _ROW_BITS))
    inside = Window.partitionBy("_part", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part", *keys).agg(*[F.sum(m).alias(f"_sum_{n}") for n, m in sums.items()])
    parts = parts.select("_part", *keys, *[F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_off_{n}") for n in sums])
    out = placed
    for n, m in sums.items():
        out = out.withColumn(n, F.coalesce(F.sum(m).over(inside), F.lit(0)))
    out = out.join(parts, ["_part", *keys])
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_off_{n}")).alias(n) for n in sums])
