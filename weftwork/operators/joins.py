"""Two-input joins and sub-query filters.

No side is hinted as broadcast: AQE turns a join into a broadcast once the
measured side is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
splits skewed partitions of the shuffled join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from weftwork.functions.scalar import COMPARISON
from weftwork.operators.lookups import CELL, ENDS, range_cells
from weftwork.session import stage

NORMAL = "Normal Join"
MASTER_OUTER = "Master Outer Join"
DETAIL_OUTER = "Detail Outer Join"
FULL_OUTER = "Full Outer Join"


def condition(pairs: list[tuple[Column, str, Column]]) -> Column:
    """AND of comparisons; the equalities hash the rows, the rest is checked on candidates."""
    return reduce(lambda a, b: a & b, [COMPARISON[op](left, right) for left, op, right in pairs])


def joiner(master: DataFrame, detail: DataFrame, cond: list[tuple[str, str, str]], kind: str = NORMAL) -> DataFrame:
    """Join on ``(master column, operator, detail column)`` triples.

    Master outer keeps all detail rows, detail outer all master rows. Without
    an equality the widest range among the comparisons is tiled (see
    ``range_pairs``), so rows meet only where that range holds; ``<>`` alone
    asks for nearly all pairs and is an error. Column names of the inputs must
    differ; rename before joining.
    """
    if not any(op == "=" for _, op, _ in cond):
        return _range_joined(master, detail, cond, kind)
    on = condition([(master[m], op, detail[d]) for m, op, d in cond])
    if kind == NORMAL:
        return master.join(detail, on, "inner")
    if kind == MASTER_OUTER:
        return detail.join(master, on, "left").select(*master.columns, *detail.columns)
    if kind == DETAIL_OUTER:
        return master.join(detail, on, "left")
    if kind == FULL_OUTER:
        # A full join cannot split a hot key; a left and an anti join over the same exchanges can.
        unmatched = detail.join(master, on, "left_anti")
        return master.join(detail, on, "left").unionByName(unmatched, allowMissingColumns=True)
    raise ValueError(f"unknown join type {kind!r}")


_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _widest_range(cond: list[tuple[str, str, str]]) -> tuple[bool, str, dict[str, tuple[str, bool]]]:
    """(whether the value is of the master, its name, end → (column of the other side, open)): the column with the most ends."""
    found: dict[tuple[bool, str], dict[str, tuple[str, bool]]] = {}
    for m, op, d in cond:
        if op in ENDS:
            for ours, by, theirs, of_master in ((m, op, d, True), (d, _FLIPPED[op], m, False)):
                end, is_open = ENDS[by]
                found.setdefault((of_master, ours), {}).setdefault(end, (theirs, is_open))
    if not found:
        raise ValueError("a join needs an equality or a range")
    of_master, ours = max(found, key=lambda k: len(found[k]))
    return of_master, ours, found[of_master, ours]


def _range_joined(master: DataFrame, detail: DataFrame, cond: list[tuple[str, str, str]], kind: str) -> DataFrame:
    """A join without equality: rows meet in the cells that tile the range, then the other comparisons are checked.

    Both inputs are written once. Rows without a partner are told from the smallest and largest value that the cells hold for the other
    comparison, where there is one at most, so pairs are neither kept nor counted. With more comparisons the pairs are written and their rows left out.
    """
    if kind not in (NORMAL, MASTER_OUTER, DETAIL_OUTER, FULL_OUTER):
        raise ValueError(f"unknown join type {kind!r}")
    of_master, ours, ends = _widest_range(cond)
    left = stage(master.withColumn("_left", F.monotonically_increasing_id()), "master")
    right = stage(detail.withColumn("_right", F.monotonically_increasing_id()), "detail")
    points, ranges = (left, right) if of_master else (right, left)
    turned = [(m, op, d) if of_master else (d, _FLIPPED.get(op, op), m) for m, op, d in cond]  # the value's side first
    more = [(p, op, r) for p, op, r in turned if not (p == ours and op in ENDS and ends[ENDS[op][0]] == (r, ENDS[op][1]))]
    told = kind != NORMAL and len(more) <= 1 and all(_one_order(points.schema[p].dataType, ranges.schema[r].dataType) for p, _, r in turned)
    sides = {f"_{end}0": F.col(f"`{column}`") for end, (column, _) in ends.items()}
    spread_of = lambda column, name: [f(F.col(f"`{column}`")).alias(f"_{name}{i}") for i, f in enumerate((F.min, F.max))]
    extent = [spread_of(more[0][i], name) if told and more else [] for i, name in ((0, "p"), (2, "r"))]
    grouped = lambda df, keys, aggs: (df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct())
    values = grouped(points.filter(points[ours].isNotNull()), [points[ours].alias("_v0")], extent[0])
    bands = grouped(ranges.filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in sides.values()])), [c.alias(n) for n, c in sides.items()], extent[1])
    cells, tiles = range_cells(values, bands, {end: is_open for end, (_, is_open) in ends.items()})
    cells = stage(cells, "cells")
    tiles = stage(tiles.join(cells.select(*CELL).distinct(), CELL, "left_semi"), "tiles")
    of_value = lambda df: [points[ours] == df["_v0"]]
    of_band = lambda df: [ranges[column] == df[f"_{end}0"] for end, (column, _) in ends.items()]
    valued, banded = cells.select("_v0", *CELL), tiles.select(*sides, *CELL)
    met = (points.join(valued, of_value(valued)).drop("_v0").join(ranges.join(banded, of_band(banded)).drop(*sides), CELL)
           .filter(condition([(left[m], op, right[d]) for m, op, d in cond])).select(*master.columns, *detail.columns, "_left", "_right"))
    columns = [*master.columns, *detail.columns]
    if kind == NORMAL:
        return met.select(*columns)
    if told:
        alone = {"points": lambda: _alone(points, of_value, ["_v0"], cells, tiles, "r", more and (more[0][0], more[0][1])),
                 "ranges": lambda: _alone(ranges, of_band, list(sides), tiles, cells, "p", more and (more[0][2], _FLIPPED.get(more[0][1], more[0][1])))}
    else:
        met = stage(met, "met")
    out = met.select(*columns)
    for side, row, kinds in ((left, "_left", (DETAIL_OUTER, FULL_OUTER)), (right, "_right", (MASTER_OUTER, FULL_OUTER))):
        if kind in kinds:
            lonely = alone["points" if side is points else "ranges"]() if told else side.join(met.select(row).distinct(), row, "left_anti")
            out = out.unionByName(lonely.drop(row), allowMissingColumns=True)
    return out.select(*columns)


def _one_order(a: DataType, b: DataType) -> bool:
    """Whether the values of both types are compared in the order that sorts each of them."""
    return a == b or (isinstance(a, NumericType) and isinstance(b, NumericType))


def _alone(side: DataFrame, on: Callable, keys: list[str], own: DataFrame, others: DataFrame, name: str, more: tuple[str, str] | list) -> DataFrame:
    """Rows of ``side`` that have no partner: whose cells (``own``, by ``keys``) hold nothing of the others, or nothing that ``more`` (column, operator) accepts."""
    low, high = f"_{name}0", f"_{name}1"
    ends = [F.min(low).alias(low), F.max(high).alias(high)] if more else [F.lit(True).alias("_met")]
    there = own.select(*keys, *CELL).join(others.groupBy(*CELL).agg(*ends) if more else others.select(*CELL).distinct(), CELL)
    there = there.groupBy(*keys).agg(*ends) if more else there.select(*keys, *ends).distinct()
    joined = side.join(there, on(there), "left")
    if not more:
        found = there["_met"]
    else:
        column, op = more
        at = {"<": [high], "<=": [high], ">": [low], ">=": [low]}.get(op, [low, high])
        found = reduce(lambda a, b: a | b, [COMPARISON[op](side[column], there[n]) for n in at])
    return joined.filter(~F.coalesce(found, F.lit(False))).select(*[side[c] for c in side.columns])


def source_join(tables: list[DataFrame], on: list[Column]) -> DataFrame:
    """Several tables of one source read, joined left to right; ``on[i]`` links table i+1 to those before it."""
    return reduce(lambda left, step: left.join(step[0], step[1], "inner"), zip(tables[1:], on), tables[0])


def not_in(df: DataFrame, key: str, sub: DataFrame, sub_key: str) -> DataFrame:
    """SQL ``key NOT IN (SELECT sub_key …)`` as a partitioned anti join.

    Spark runs the SQL form by broadcasting the sub-query. Here the NULL rules
    are two scalars: any NULL in the sub-query keeps no row, and a NULL key is
    kept only when the sub-query is empty.
    """
    values = sub.select(F.col(sub_key).alias("_k"))
    # count_if over no rows is 0, and one row always comes back, so both scalars exist.
    facts = values.agg(F.struct((F.count("*") == 0).alias("empty"), (F.count_if(F.col("_k").isNull()) > 0).alias("has_null")))
    stat = facts.scalar()
    left = df.join(values, df[key] == values["_k"], "left_anti")
    return left.filter(stat["empty"] | (~stat["has_null"] & F.col(key).isNotNull()))


def in_subquery(df: DataFrame, key: str, sub: DataFrame, sub_key: str) -> DataFrame:
    values = sub.select(F.col(sub_key).alias("_k"))
    return df.join(values, df[key] == values["_k"], "left_semi")
