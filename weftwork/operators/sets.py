"""Mapped union and fan-in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_groups(groups: dict[str, DataFrame], mappings: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """UNION ALL of named inputs, each with its own ``origin → union`` names; unmapped names stay."""
    mappings = mappings or {}
    renamed = [df.select(*[F.col(c).alias(mappings.get(name, {}).get(c, c)) for c in df.columns])
               for name, df in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)


def fan_in(parts: list[DataFrame]) -> DataFrame:
    """Several flows that append to one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
