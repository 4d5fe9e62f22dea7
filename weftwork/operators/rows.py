"""Projection, filtering and row reshaping."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.keys import dense_index


@dataclass(frozen=True)
class Field:
    """An output field: ``expr`` None means unconnected, so NULL of ``type``."""

    name: str
    expr: Column | None = None
    type: str | None = None


def project(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Evaluate each field's expression, cast it and name it; only these columns are read."""
    out = []
    for f in fields:
        c = F.lit(None) if f.expr is None else f.expr
        out.append((c if f.type is None else c.try_cast(f.type)).alias(f.name))
    return df.select(*out)


def with_variables(df: DataFrame, ordered: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """Local variables: each may use the earlier ones; only ``keep`` of them leave the step."""
    inputs = df.columns
    for name, expr in ordered:
        df = df.withColumn(name, expr)
    return df.select(*inputs, *[k for k in keep if k not in inputs])


def keep_true(df: DataFrame, cond: Column | str) -> DataFrame:
    """Filter: rows whose condition is TRUE; NULL drops the row."""
    return df.filter(cond)


def source_filter(df: DataFrame, sql_cond: str, alias: str | None = None) -> DataFrame:
    """Source-qualifier WHERE fragment; ``alias`` lets it name the table."""
    return (df.alias(alias) if alias else df).where(sql_cond)


def select_distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def tag_groups(df: DataFrame, groups: dict[str, Column], default: str | None = None, name: str = "ROUTE") -> DataFrame:
    """Router in one pass: one output row for every group whose condition is TRUE.

    ``default`` names the group of rows that match none; NULL counts as no match.
    """
    hits = F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in groups.items()]))
    if default is not None:
        hits = F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)
    return df.withColumn(name, F.explode(hits))


def route(df: DataFrame, groups: dict[str, Column], default: str | None = None) -> dict[str, DataFrame]:
    """Router as one DataFrame a group; each is a filter that can reach the scan."""
    out = {g: df.filter(c) for g, c in groups.items()}
    if default is not None:
        none = F.lit(True)
        for c in groups.values():
            none = none & ~F.coalesce(c, F.lit(False))
        out[default] = df.filter(none)
    return out


def normalize(df: DataFrame, fields: dict[str, list[str]], gcid: bool = False, gk: bool = False,
              order_by: list[str | Column] | None = None) -> DataFrame:
    """Normalizer: a field with N source columns becomes N rows.

    Fields with several sources are unpivoted side by side, fields with one
    source repeat on every row, and NULL occurrences are kept. ``gcid`` adds
    ``GCID_<field>`` (1..N) and ``gk`` adds ``GK_<field>``, one number for each
    input row in the order of ``order_by``.
    """
    repeated = {f: cols for f, cols in fields.items() if len(cols) > 1}
    single = {f: cols[0] for f, cols in fields.items() if len(cols) == 1}
    if gk:
        if not order_by:
            raise ValueError("a generated key needs order_by")
        df = dense_index(df, order_by, "_gk")
    depth = max((len(c) for c in repeated.values()), default=1)
    padded = [F.array(*[F.col(c) for c in cols], *[F.lit(None)] * (depth - len(cols))).alias(f)
              for f, cols in repeated.items()]
    kept = [F.col(c).alias(f) for f, c in single.items()] + ([F.col("_gk")] if gk else [])
    if not repeated:
        return df.select(*kept)
    spread = df.select(*kept, F.posexplode(F.arrays_zip(*padded)).alias("_pos", "_occ"))
    out = [F.col(f) for f in single] + [F.col(f"_occ.{f}").alias(f) for f in repeated]
    for f in repeated:
        if gcid:
            out.append((F.col("_pos") + 1).alias(f"GCID_{f}"))
        if gk:
            out.append(F.col("_gk").alias(f"GK_{f}"))
    return spread.select(*out)


def mapplet(df: DataFrame, steps: Callable[[DataFrame], DataFrame], inputs: dict[str, str], outputs: dict[str, str]) -> DataFrame:
    """Reusable sub-flow: ``inputs`` maps its ports to our columns, ``outputs`` our columns to its ports."""
    fed = df.select("*", *[F.col(src).alias(port) for port, src in inputs.items()])
    done = fed.transform(steps)
    return done.select(*df.columns, *[F.col(port).alias(ours) for ours, port in outputs.items()])


_GLOBALS: dict[str, Callable[..., Column]] = {}


def register_global(name: str, fn: Callable[..., Column]) -> None:
    """Share a named expression between mappings."""
    _GLOBALS[name] = fn


def apply_global(name: str, *ports: Column) -> Column:
    return _GLOBALS[name](*ports)


def parametrised_sql(spark: SparkSession, sql: str, params: dict[str, object], **views: DataFrame) -> DataFrame:
    """SQL override with ``$$NAME`` parameters bound as values, never pasted as text."""
    whole = re.fullmatch(r"\s*\$\$(\w+)\s*;?\s*", sql)
    if whole:  # the override is the parameter itself: its value is the query
        return spark.sql(str(params[whole[1]]), **views)
    names = "|".join(re.escape(n) for n in sorted(params, key=len, reverse=True))
    if names:  # text in quotes is left as it is
        sql = re.sub(rf"('(?:[^']|'')*')|\$\$({names})\b", lambda m: m[1] or f":{m[2]}", sql)
    return spark.sql(sql, args=dict(params), **views)
