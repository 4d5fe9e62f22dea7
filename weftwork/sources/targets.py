"""Write modes, upsert, multi-target and dated feeds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import stage

# Write-mode and partition-type names.
APPEND = "APPEND"
TRUNCATE_INSERT = "TRUNCATE_INSERT"
ORPHAN = "ORPHAN_WRITE_MODES"
DELTA_PARTITIONED = "DELTA_PARTITIONED"
DELTA_SUB_PARTITIONED = "DELTA_SUB_PARTITIONED"
DAILY, MONTHLY, UNKNOWN = "DAILY", "MONTHLY", "UNKNOWN_PARTITION_TYPE"


def partition_by(df: DataFrame, kind: str, key: str, name: str = "PARTITION_KEY") -> DataFrame:
    """Add the DAILY or MONTHLY partition key derived from date column ``key``; other kinds add none."""
    if kind == DAILY:
        return df.withColumn(name, F.to_date(key))
    if kind == MONTHLY:
        return df.withColumn(name, F.trunc(F.to_date(key), "month"))
    return df


def write_target(df: DataFrame, path: str, mode: str = APPEND, partitions: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write with a recipe write mode.

    The delta modes replace only the partitions present in ``df`` and need
    ``partitions``. Rows are shuffled to their partition with a spread over
    part files by AQE, so a partition is neither thousands of tiny files nor
    one giant task.
    """
    partitions = partitions or []
    if partitions:
        df = df.hint("rebalance", *partitions)
    writer = df.write.format(fmt).partitionBy(*partitions)
    if mode in (DELTA_PARTITIONED, DELTA_SUB_PARTITIONED):
        need = 1 if mode == DELTA_PARTITIONED else 2
        if len(partitions) < need:
            raise ValueError(f"{mode} needs {need} partition column(s)")
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    elif mode == TRUNCATE_INSERT:
        writer.mode("overwrite").option("partitionOverwriteMode", "static").save(path)
    elif mode in (APPEND, ORPHAN):
        writer.mode("append").save(path)
    else:
        raise ValueError(f"unknown write mode {mode!r}")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """The target after updating rows whose key is in ``source`` and inserting the others.

    Of several source rows with one key the last by ``order_by`` counts; without an order, equal keys are an error when the plan runs.
    """
    source = _one_a_key(source, keys, order_by)
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def _one_a_key(source: DataFrame, keys: list[str], order_by: list[str] | None) -> DataFrame:
    rest = F.struct(*[c for c in source.columns if c not in keys] or keys)
    best = F.max_by(rest, F.struct(*order_by)) if order_by else F.when(F.count("*") > 1, F.raise_error(F.lit("several source rows with one key need order_by"))).otherwise(F.any_value(rest))
    one = source.groupBy(*keys).agg(best.alias("_row"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in source.columns])


def upsert_table(source: DataFrame, path: str, keys: list[str], partition: str, order_by: list[str] | None = None) -> None:
    """Upsert into the Parquet table at ``path``, partitioned by ``partition``; only partitions that gain or lose a row are rewritten.

    The new content of those partitions is written below the shared folder first, because the table can't be read while it is
    overwritten. A key may move to another partition; a partition that loses its last row is removed. Partition names, as many as folders, reach the driver.
    """
    spark = source.sparkSession
    source = stage(_one_a_key(source, keys, order_by), "upsert")
    target = spark.read.parquet(path).select(*source.columns)
    found = target.join(source.select(*keys), keys, "left_semi").select(partition)
    touched = stage(found.union(source.select(partition)).distinct(), "touched")
    old = target.join(touched, target[partition].eqNullSafe(touched[partition]), "left_semi")
    fresh = stage(old.join(source.select(*keys), keys, "left_anti").unionByName(source), "upserted")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    kept = fresh.select(partition).distinct()
    for row in touched.join(kept, touched[partition].eqNullSafe(kept[partition]), "left_anti").toLocalIterator():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        value = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(row[0]))
        folder = hadoop(f"{path}/{partition}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_targets(parent: DataFrame, targets: dict[str, tuple[Callable[[DataFrame], DataFrame], str]]) -> None:
    """One flow, N targets ``path → (function of the parent, mode)``; the parent is computed once, below the shared folder."""
    shared = stage(parent, "shared")
    for path, (flow, mode) in targets.items():
        write_target(flow(shared), path, mode)


def feed_name(pattern: str, now: datetime) -> str:
    """Dates in a feed name: ``$$Date`` is yesterday, the other two are now."""
    # Placeholders and the Python form of the date each stands for.
    placeholders = [
        ("$$Date", now - timedelta(days=1), "%Y%m%d"),
        ("DDMMYYYYHH24MMSS", now, "%d%m%Y%H%M%S"),
        ("YYYYMMDD", now, "%Y%m%d"),
    ]
    for token, when, shape in placeholders:
        pattern = pattern.replace(token, when.strftime(shape))
    return pattern


def write_feed(df: DataFrame, pattern: str, now: datetime, header: bool = True) -> str:
    """Export as CSV under the resolved name; returns the path."""
    path = feed_name(pattern, now)
    df.write.mode("overwrite").option("header", header).csv(path)
    return path
