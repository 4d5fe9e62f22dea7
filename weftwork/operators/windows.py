"""Duplicates, latest and first rows.

All are partial aggregates and joins, or windows over keys counted to be small, never a window over any key: one
that holds a third of the table would put a third of it into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from weftwork.session import stage


def flag_duplicates(df: DataFrame, keys: list[str], order_by: list[str], flag: str = "FLAG_DUPLICADO") -> DataFrame:
    """``flag`` = 'Y' on every row whose key occurred earlier in the order, else 'N'.

    Rows may be equal in key and order, even in all columns: the first of a key in the order (ties by all other columns) is the one 'N', all the
    rest are 'Y'. Keys of up to FEW rows are numbered in their order; those of more, told by a count, are flagged by aggregates
    (`_flag_hot`). Maps are compared by their sorted entries.
    """
    maps = [f.name for f in df.schema if isinstance(f.dataType, MapType)]
    if maps:
        entries = df.withColumns({m: F.array_sort(F.map_entries(F.col(f"`{m}`"))) for m in maps})
        return flag_duplicates(entries, keys, order_by, flag).withColumns({m: F.map_from_entries(F.col(f"`{m}`")) for m in maps})
    order = [*order_by, *[c for c in df.columns if c not in order_by]]
    hot = stage(df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n")).filter(F.col("_n") > FEW).drop("_n"), "hot")
    some, same = not hot.isEmpty(), [df[k].eqNullSafe(hot[f"_k{i}"]) for i, k in enumerate(keys)]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = df.join(hot, same, "left_anti") if some else df
    few = few.select(*df.columns, F.when(number == 1, "N").otherwise("Y").alias(flag))
    return few.union(_flag_hot(df.join(hot, same, "left_semi"), keys, order, flag)) if some else few


FEW = 65536  # rows of a key that one task may sort


def _flag_hot(df: DataFrame, keys: list[str], order_by: list[str], flag: str) -> DataFrame:
    """`flag_duplicates` without sorting a key: equal rows collapse to one with their number, the least row of a key is the first."""
    order = F.struct(*order_by)
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = [counted[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)]
    flagged = counted.join(first, same).withColumn("_head", order.eqNullSafe(F.col("_first"))).select(*df.columns, "_copies", "_head")
    # Many equal rows come back in runs of _RUN, which are dealt out before they are written out.
    few, many = flagged.filter(F.col("_copies") <= _RUN), flagged.filter(F.col("_copies") > _RUN)
    runs = many.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / _RUN))))
    runs = runs.withColumns({"_copies": F.least(F.lit(_RUN), F.col("_copies") - F.col("_run") * _RUN), "_head": F.col("_head") & (F.col("_run") == 0)})
    dealt = few.unionByName(runs.drop("_run").repartition("_copies", *df.columns, F.rand(0)))
    flags = F.transform(F.sequence(F.lit(1), F.col("_copies").cast("int")), lambda i: F.when(F.col("_head") & (i == 1), "N").otherwise("Y"))
    return dealt.select(*df.columns, F.explode(flags).alias(flag))


_RUN = 1024


def split_duplicates(df: DataFrame, keys: list[str], order_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first occurrences, duplicates)."""
    flagged = flag_duplicates(df, keys, order_by, "_dup")
    return (flagged.filter(F.col("_dup") == "N").drop("_dup"), flagged.filter(F.col("_dup") == "Y").drop("_dup"))


def latest_per_key(df: DataFrame, keys: list[str], columns: list[str], order_by: list[str]) -> DataFrame:
    """``columns`` of each key's last row in the order of ``order_by``."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order_by)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def first_by(df: DataFrame, keys: list[str], columns: list[str], order_by: list[str]) -> DataFrame:
    """``columns`` of each key's first row in the declared order."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order_by)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def history(daily: DataFrame, key: str, columns: list[str], date: str = "run_date", name: str = "history") -> DataFrame:
    """Ordered array of ``(date, columns…)`` for each key.

    ``daily`` holds one row a key and day, so an array is bounded by the days
    in the calendar, not by the number of rows loaded.
    """
    return daily.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(date, *columns))).alias(name))
