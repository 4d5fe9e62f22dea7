"""Lookups: at most one match a row, a miss gives NULL, rows are never multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.keys import dense_index
from weftwork.session import stage

FIRST, LAST, ANY = "First", "Last", "Any"


def _of(df: DataFrame, name: str) -> Column:
    """Column of ``df`` whose name may hold dots."""
    return df[f"`{name}`"]


def _pick(policy: str, value: Column, order_by: list[str] | None) -> Column:
    """The aggregate that keeps one of several matches; partial, so hot keys shrink before the shuffle."""
    if policy == ANY:
        return F.min(value)
    if not order_by:
        raise ValueError(f"match policy {policy} needs order_by")
    order = F.struct(*order_by)
    return {FIRST: F.min_by, LAST: F.max_by}[policy](value, order)


def one_per_key(table: DataFrame, keys: list[str], outputs: list[str], policy: str, order_by: list[str] | None) -> DataFrame:
    """The lookup side reduced to one row a key."""
    picked = table.groupBy(*keys).agg(_pick(policy, F.struct(*outputs), order_by).alias("_m"))
    return picked.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in outputs])


def lookup(df: DataFrame, table: DataFrame, on: list[tuple[str, str]], outputs: dict[str, str],
           policy: str = FIRST, order_by: list[str] | None = None, source_filter: Column | str | None = None) -> DataFrame:
    """Connected lookup on ``(our column, lookup column)`` equalities.

    ``outputs`` maps new column names to lookup columns; however many there
    are, the table is joined once. It is filtered and reduced to one row a key
    before the join.
    """
    if source_filter is not None:
        table = table.filter(source_filter)
    keys = [k for _, k in on]
    wanted = list(dict.fromkeys(outputs.values()))
    side = one_per_key(table, keys, [c for c in wanted if c not in keys] or keys[:1], policy, order_by) \
        if any(c not in keys for c in wanted) else table.select(*keys).distinct()
    side = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       *[F.col(src).alias(f"_o{i}") for i, src in enumerate(outputs.values())])
    cond = [_of(df, ours) == side[f"_k{i}"] for i, (ours, _) in enumerate(on)]
    joined = df.join(side, cond, "left")
    return joined.select(*[_of(df, c) for c in df.columns], *[side[f"_o{i}"].alias(n) for i, n in enumerate(outputs)])


def lookup_value(df: DataFrame, name: str, table: DataFrame, on: list[tuple[str, str]], output: str, expr,
                 policy: str = FIRST, order_by: list[str] | None = None) -> DataFrame:
    """Unconnected lookup: the looked-up value exists only inside ``expr(value)``, which becomes column ``name``."""
    found = lookup(df, table, on, {"_lkp": output}, policy, order_by)
    return found.withColumn(name, expr(F.col("_lkp"))).drop("_lkp")


UNLIKE = ("<>", "!=")
ENDS = {">=": ("low", False), ">": ("low", True), "<=": ("high", False), "<": ("high", True)}


def lookup_where(df: DataFrame, table: DataFrame, on: list[tuple[str, str, str]], outputs: dict[str, str],
                 policy: str = FIRST, order_by: list[str] | None = None) -> DataFrame:
    """Lookup on ``(our column, operator, lookup column)`` conditions that must all hold.

    Any equalities, ranges on any number of our columns (a lower bound, an upper one or both, open or closed), and one
    ``<>``. No row meets table rows only to be compared with them:

    * Ranges are tiled. Values and band ends are ranked in one distributed sort, behind the equality keys; a band is an
      interval of ranks and is filed under the cells that tile it exactly. The bands of a cell reduce to the one
      the policy picks, so a distinct value meets one entry a level at most, whatever the widths and
      overlaps of the bands. With several ranged columns the cells of one are keys of the next.
    * For ``<>`` each key keeps its best row and the best one with another value: one of the two answers.

    NULL meets nothing, on either side, in any condition. Numbers, dates, timestamps and texts have ranges.
    """
    if policy != ANY and not order_by:
        raise ValueError(f"match policy {policy} needs order_by")
    equal = [(o, t) for o, op, t in on if op == "="]
    unlike = [(o, t) for o, op, t in on if op in UNLIKE]
    ranges: dict[str, dict[str, tuple[str, bool]]] = {}
    for ours, op, theirs in on:
        if op in ENDS:
            end, is_open = ENDS[op]
            if end in ranges.setdefault(ours, {}):
                raise ValueError(f"a range takes one {'lower' if end == 'low' else 'upper'} bound: {ours}")
            ranges[ours][end] = (theirs, is_open)
        elif op not in ("=", *UNLIKE):
            raise ValueError(f"unknown operator {op}")
    if len(unlike) > 1 or not on:
        raise ValueError("a lookup takes conditions, among them one <> at most")

    best = F.max if policy == LAST else F.min
    order = F.struct(*order_by) if policy != ANY else F.struct(F.lit(0))
    keys, other = [f"_k{i}" for i in range(len(equal))], ["_other"] if unlike else []
    ours = [o for o, _ in equal] + list(ranges)
    asked = df.select(*[F.col(f"`{o}`").alias(n) for n, o in zip(keys + [f"_v{i}" for i in range(len(ranges))], ours)])
    wanted = asked.columns
    there = {**{k: t for k, (_, t) in zip(keys, equal)}, **{n: t for n, (_, t) in zip(other, unlike)},
             **{f"_{end}{i}": t for i, ends in enumerate(ranges.values()) for end, (t, _) in ends.items()}}
    bands = _without_nulls(table.select(*[F.col(t).alias(n) for n, t in there.items()],
                                        F.struct(order.alias("o"), F.struct(*dict.fromkeys(outputs.values())).alias("m")).alias("_best")), list(there))
    if ranges:
        open_ends = [{end: is_open for end, (_, is_open) in ends.items()} for ends in ranges.values()]
        picked = _ranged(_without_nulls(asked, wanted).distinct(), bands, keys, open_ends, best, other)
    else:
        picked = _reduced(bands, keys, best, other)
    if other:
        picked = picked.groupBy(*wanted).agg(*[F.max(F.when(F.col("_nth") == i, F.struct("_other", "_best"))).alias(f"_best{i}") for i in (1, 2)])
    if wanted:
        joined = df.join(picked, [_of(df, o) == picked[w] for w, o in zip(wanted, ours)], "left")
        mine = lambda c: _of(df, c)
    else:  # <> alone: two rows of the table answer for all
        joined = df.withColumns({n: picked.select(n).scalar() for n in ("_best1", "_best2")})
        mine = lambda c: F.col(f"`{c}`")
    if other:
        found = F.coalesce(*[F.when(F.col(f"{n}._other") != mine(unlike[0][0]), F.col(f"{n}._best.m")) for n in ("_best1", "_best2")])
    else:
        found = F.col("_best.m")
    return joined.select(*[mine(c) for c in df.columns], *[found[src].alias(n) for n, src in outputs.items()])


def range_lookup(df: DataFrame, table: DataFrame, value: str, low: str | None, high: str | None, cell: float | None, outputs: dict[str, str],
                 on: list[tuple[str, str]] = (), policy: str = FIRST, order_by: list[str] | None = None,
                 low_open: bool = False, high_open: bool = False) -> DataFrame:
    """``lookup_where`` on ``low <= value <= high`` (open if asked, one end may be None) and equalities ``on``; ``cell`` has no effect any more."""
    ends = [(value, ">" if low_open else ">=", low), (value, "<" if high_open else "<=", high)]
    conditions = [(o, "=", t) for o, t in on] + [e for e in ends if e[2] is not None]
    if len(conditions) == len(on):
        raise ValueError("a range needs a lower or an upper bound")
    return lookup_where(df, table, conditions, outputs, policy, order_by)


def _without_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def _reduced(rows: DataFrame, keys: list[str], best, other: list[str]) -> DataFrame:
    """The best row of each key; with ``other`` also the best that has another value there, numbered by ``_nth``. Tasks drop the rest before a shuffle."""
    each = rows.groupBy(*keys, *other).agg(best("_best").alias("_best"))
    if not other:
        return each
    by = F.col("_best").desc() if best is F.max else F.col("_best").asc()
    return each.withColumn("_nth", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(by, *other))).filter("_nth <= 2")


def _ranged(asked: DataFrame, bands: DataFrame, keys: list[str], ranges: list[dict[str, bool]], best, other: list[str]) -> DataFrame:
    """``asked`` (keys ``_k…``, values ``_v…``) with the ``_best`` band that holds the values, where there is one; two rows with ``other``."""
    probes = stage(asked.withColumn("_ask", F.monotonically_increasing_id()), "asked")
    rows, cells = probes, list(keys)
    for i, ends in enumerate(ranges):
        later = [f"_{end}{j}" for j in range(i + 1, len(ranges)) for end in ranges[j]]
        bands = stage(bands.groupBy(*cells, *[f"_{end}{i}" for end in ends], *later, *other).agg(best("_best").alias("_best"))
                      .withColumn("_band", F.monotonically_increasing_id()), "bands")
        count = bands.count()  # of file footers
        rows, bands = (_in_distinct_ranks if later else _in_ranks)(rows, bands, cells, i, ends)
        bands = _dealt(bands, count)
        level, cell = f"_level{i}", f"_cell{i}"
        tiles = bands.withColumn("_tile", F.explode(F.expr(_TILES))).withColumns({level: F.col("_tile.level"), cell: F.col("_tile.cell")})
        cells += [level, cell]
        bands = stage(tiles.groupBy(*cells, *later, *other).agg(best("_best").alias("_best")), "tiles")
        levels = bands.agg(F.collect_set(level)).scalar()
        rows = rows.withColumn(level, F.explode(levels)).withColumn(cell, F.expr(f"shiftright(_rank, {level} * {_LEVEL_BITS})")).drop("_rank", f"_v{i}")
        if later:  # only cells that hold bands go on
            rows = rows.join(bands.select(*cells).distinct(), cells, "left_semi")
    met = rows.select(*cells, "_ask").join(_reduced(bands, cells, best, other).drop("_nth") if other else bands, cells)
    return probes.join(_reduced(met, ["_ask"], best, other), "_ask").drop("_ask")


def _dealt(bands: DataFrame, count: int) -> DataFrame:
    """``count`` bands over tasks of about BANDS_A_TASK, neighbours together, as these have tiles in common."""
    return bands.repartitionByRange(max(bands.sparkSession.sparkContext.defaultParallelism, -(-count // BANDS_A_TASK)), "_first", "_band")


def _in_ranks(rows: DataFrame, bands: DataFrame, keys: list[str], i: int, ends: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the ``_rank`` of value ``_v{i}``, ``bands`` with the ranks ``_first``, ``_last`` of their ends, all in one order.

    Behind equal keys an end stands before or after the values equal to it, as it is closed or open, and a missing
    end before or after them all, so a value is in a band exactly when its rank is between those of the ends.
    """
    value = F.col(f"_v{i}")
    nothing = F.lit(None).cast(rows.schema[f"_v{i}"].dataType)
    low = F.struct(F.lit(True).alias("low"), F.lit(0 if "low" in ends else -1).alias("side"), (F.col(f"_low{i}") if "low" in ends else nothing).alias("at"),
                   F.lit(2 if ends.get("low") else 0).alias("tie"))
    high = F.struct(F.lit(False).alias("low"), F.lit(0 if "high" in ends else 1).alias("side"), (F.col(f"_high{i}") if "high" in ends else nothing).alias("at"),
                    F.lit(0 if ends.get("high") else 2).alias("tie"))
    points = bands.select(*keys, "_band", F.explode(F.array(low, high)).alias("e")).select(*keys, "e.*", F.col("_band").alias("id"))
    mine = rows.select(*keys, F.lit(0).alias("side"), value.alias("at"), F.lit(1).alias("tie"), F.col("_ask").alias("id"), F.struct(*rows.columns).alias("_mine"))
    placed = dense_index(points.unionByName(mine, allowMissingColumns=True), [*keys, "side", "at", "tie", "id"], "_rank", start=0, pin=lambda df: stage(df, "ranks"))
    spans = (placed.filter("low IS NOT NULL").groupBy(F.col("id").alias("_band"))
             .agg(F.max(F.when(F.col("low"), F.col("_rank"))).alias("_first"), F.max(F.when(~F.col("low"), F.col("_rank"))).alias("_last")))
    return placed.filter("low IS NULL").select("_mine.*", "_rank"), bands.join(spans.filter("_first < _last"), "_band")


def _in_distinct_ranks(rows: DataFrame, bands: DataFrame, keys: list[str], i: int, ends: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """`_in_ranks` with one rank for all equal values and one for all equal ends, so levels follow the distinct ones.

    For all ranges but the last, whose rows and tiles are multiplied by the levels. ``rows`` and ``bands`` are read twice.
    """
    kind = rows.schema[f"_v{i}"].dataType
    place = lambda side, at, tie: F.struct(F.lit(side).alias("side"), at.alias("at"), F.lit(tie).alias("tie"))
    low = (0, F.col(f"_low{i}"), 2 if ends["low"] else 0) if "low" in ends else (-1, None, 0)
    high = (0, F.col(f"_high{i}"), 0 if ends["high"] else 2) if "high" in ends else (1, None, 2)
    mine = (0, F.col(f"_v{i}"), 1)
    pair = [place(side, F.lit(None).cast(kind) if at is None else at, tie) for side, at, tie in (low, high)]
    points = bands.select(*keys, F.explode(F.array(*pair)).alias("e")).union(rows.select(*keys, place(*mine))).select(*keys, "e.*").distinct()
    placed = dense_index(points, [*keys, "side", "at", "tie"], "_rank", start=0, pin=lambda df: stage(df, "ranks"))

    def ranked(df, point, name):
        side, at, tie = point
        there = placed.filter((F.col("side") == side) & (F.col("tie") == tie)).select(*[F.col(k).alias(f"_of{k}") for k in keys], F.col("at").alias("_at"), F.col("_rank").alias(name))
        on = [F.col(k) == F.col(f"_of{k}") for k in keys] + ([at.cast(placed.schema["at"].dataType) == F.col("_at")] if at is not None else [])
        return df.join(there, on).drop(*[f"_of{k}" for k in keys], "_at") if on else df.withColumn(name, there.select(name).scalar())

    return ranked(rows, mine, "_rank"), ranked(ranked(bands, low, "_first"), high, "_last").filter("_first < _last")


def range_cells(values: DataFrame, bands: DataFrame, ends: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """(cells, tiles): the cells that each row of ``values`` lies in and those that tile each row of ``bands``, by ``_level`` and ``_cell``.

    ``values`` has distinct ``_v0`` and ``bands`` distinct ends, neither with NULLs; their other columns stay. ``ends`` maps ``low`` and ``high``,
    or one of them, to whether that end is open; the columns are ``_low0`` and ``_high0``. The cells of a band tile it without overlap, so
    a value and a band that holds it share exactly one cell, others none. Cells of no band are left out, so both grow with their input only.
    """
    asked = stage(values.withColumn("_ask", F.monotonically_increasing_id()), "asked")
    spans = stage(bands.withColumn("_band", F.monotonically_increasing_id()), "bands")
    count = spans.count()  # of file footers
    rows, spans = _in_ranks(asked, spans, [], 0, ends)
    spans = _dealt(spans, count)
    tiles = stage(spans.select(F.explode(F.expr(_TILES)).alias("_tile"), *bands.columns)
                  .select(F.col("_tile.level").alias("_level"), F.col("_tile.cell").alias("_cell"), *bands.columns), "tiles")
    levels = tiles.agg(F.collect_set("_level")).scalar()
    other = [c for c in values.columns if c != "_v0"]
    cells = rows.withColumn("_level", F.explode(levels)).select("_v0", "_level", F.expr(f"shiftright(_rank, _level * {_LEVEL_BITS})").alias("_cell"), *other)
    return cells.join(tiles.select(*CELL).distinct(), CELL, "left_semi"), tiles


CELL = ["_level", "_cell"]


def range_pairs(values: DataFrame, bands: DataFrame, ends: dict[str, bool]) -> DataFrame:
    """Every (``_v0``, ends) where a distinct value of ``values`` (column ``_v0``) lies in a distinct band of ``bands``.

    ``ends`` and the columns are those of `range_cells`. The join is an equality on cells and gives no row beyond the answer. NULLs lie nowhere.
    """
    sides = [f"_{end}0" for end in ends]
    cells, tiles = range_cells(_without_nulls(values, ["_v0"]).distinct(), _without_nulls(bands, sides).distinct(), ends)
    return cells.join(tiles, CELL).select("_v0", *sides)


def _tile_sql(bits: int, top: int) -> str:
    """Cells (level, cell) that exactly tile the ranks ``_first`` to ``_last``.

    A level-l cell holds 2**(bits*l) ranks. ``lo``/``hi`` are the first and last level-l cell inside the
    band; those inside a level-(l+1) cell of the band are left to it, except at the top.
    """
    lo = lambda l: f"-shiftright(-_first, ({l}) * {bits})"
    hi = lambda l: f"shiftright(_last + 1, ({l}) * {bits}) - 1"
    run = lambda a, b: f"if({a} <= {b}, sequence({a}, {b}), cast(array() as array<bigint>))"
    inner_lo, inner_hi = f"(({lo('l + 1')}) * {1 << bits})", f"(({hi('l + 1')} + 1) * {1 << bits})"
    cells = (f"if(l < {top} AND {lo('l + 1')} <= {hi('l + 1')}, "
             f"concat({run(lo('l'), inner_lo + ' - 1')}, {run(inner_hi, hi('l'))}), {run(lo('l'), hi('l'))})")
    return (f"flatten(transform(sequence(0, {top}), l -> "
            f"transform({cells}, c -> named_struct('level', l, 'cell', c))))")


BANDS_A_TASK = 16384  # each grows to some dozens of tiles, which the task sorts
_LEVEL_BITS = 2  # a cell is four of the next finer ones
_TOP_LEVEL = 24  # cells of 2**48 ranks, more than any table has
_TILES = _tile_sql(_LEVEL_BITS, _TOP_LEVEL)


def only_new(df: DataFrame, target: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Insert-only pattern: rows whose key the target does not hold yet."""
    side = target.select(*[F.col(t).alias(f"_k{i}") for i, (_, t) in enumerate(keys)])
    return df.join(side, [_of(df, o) == side[f"_k{i}"] for i, (o, _) in enumerate(keys)], "left_anti")
