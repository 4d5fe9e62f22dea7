"""Tables, declared schemas, SQL overrides, freshest partition, active sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_source(spark: SparkSession, name: str, root: str | None = None, primary_keys: list[str] | None = None) -> DataFrame:
    """A named table with upper-case column names; ``primary_keys`` are checked to exist and marked in the metadata."""
    df = spark.table(name) if root is None else spark.read.parquet(f"{root}/{name.lower()}.parquet")
    keys = {k.upper() for k in primary_keys or []}
    missing = keys - {c.upper() for c in df.columns}
    if missing:
        raise ValueError(f"{name}: no such key column {sorted(missing)}")
    return df.select(*[F.col(c).alias(c.upper(), metadata={"primary_key": True}) if c.upper() in keys
                       else F.col(c).alias(c.upper()) for c in df.columns])


# Declared source types (lower case) and the run-time type each one means.
TABLE_TYPES = {
    "varchar2": "string", "varchar": "string", "nvarchar2": "string", "string": "string",
    "char": "string", "clob": "string", "nchar": "string",
    "number": "decimal(38,9)", "integer": "bigint",
    "date": "timestamp_ntz", "datetime": "timestamp_ntz", "timestamp": "timestamp",
}
PORT_TYPES = {
    "string": "string", "nstring": "string", "text": "string",
    "double": "decimal(38,9)", "decimal": "decimal(38,9)",
    "date/time": "timestamp", "bigint": "bigint", "integer": "int",
}
INT64_DIGITS = 19  # declared integers with fewer digits fit a bigint


def spark_type(declared: str, precision: int | None = None, scale: int | None = None, port: bool = False) -> str:
    """Run-time type of a declared table type, or of a port type with ``port=True``."""
    name = declared.strip().lower()
    if not port and name in ("number(p,s)", "number(p)"):
        scale = 0 if name == "number(p)" else int(scale or 0)
        return "bigint" if scale == 0 and int(precision) < INT64_DIGITS else f"decimal({precision},{scale})"
    types = PORT_TYPES if port else TABLE_TYPES
    if name not in types:
        raise ValueError(f"unknown declared type {declared!r}")
    return types[name]


def apply_schema(df: DataFrame, fields: list[tuple]) -> DataFrame:
    """Cast columns to their declared ``(name, type[, precision, scale])``; a value that does not fit becomes NULL."""
    return df.select(*[F.col(name).try_cast(spark_type(*declared)).alias(name) for name, *declared in fields])


def source_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """A full SQL override over named inputs, written as ``{name}`` in the text."""
    return spark.sql(sql, **views)


def freshest_partition(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows of the newest date; the maximum is a scalar sub-query, so nothing is joined."""
    newest = df.agg(F.max(F.to_date(ts_col)).alias("d")).scalar()
    return df.filter(F.to_date(ts_col) == newest)


def active_sources(entries: DataFrame, run_date: str) -> DataFrame:
    """Active sources of control entries with the date to read, ``dayOffset`` days before ``run_date``."""
    return (entries.select("recipe", F.explode("sources").alias("s")).filter(F.col("s.active"))
            .select("recipe", F.col("s.table").alias("table"),
                    F.date_sub(F.lit(run_date).cast("date"), F.col("s.day_offset")).alias("read_date")))
