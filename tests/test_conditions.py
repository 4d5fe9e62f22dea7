"""Lookups on ranges, several ranged columns and ``<>`` against brute force, and how many rows they compare."""

import datetime
import random

import pytest

from weftwork.operators import joins as J
from weftwork.operators import lookups as L

HOLDS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def brute(rows, bands, on, policy):
    """ours → n of the picked band; rows and bands are dictionaries, n orders the bands."""
    out = []
    for r in rows:
        hits = [b["n"] for b in bands if all(r[o] is not None and b[t] is not None and HOLDS[op](r[o], b[t]) for o, op, t in on)]
        out.append((r["i"], (max if policy == "Last" else min)(hits) if hits else None))
    return sorted(out, key=str)


def both(spark, rows, bands, row_type, band_type, on, policy):
    df, table = spark.createDataFrame([tuple(r.values()) for r in rows], row_type), spark.createDataFrame([tuple(b.values()) for b in bands], band_type)
    out = L.lookup_where(df, table, on, {"n": "n"}, policy, ["n"])
    assert out.columns == [*df.columns, "n"]
    return sorted(((r["i"], r["n"]) for r in out.collect()), key=str), brute(rows, bands, on, policy)


@pytest.mark.parametrize("policy", ["First", "Last"])
def test_widths_of_any_scale(spark, monkeypatch, policy):
    """widths from a billionth to everything; thousands of narrow bands beside each other; repeated, negative and missing values"""
    rnd = random.Random(5)
    bands = []
    for n in range(700):
        low = rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e6), 5 + n * 1e-6, -0.0, float(rnd.randint(-3, 3))])
        bands.append({"lo": rnd.choice([low] * 30 + [None]), "hi": low + rnd.choice([0.0, 1e-9, 1e-6 * rnd.paretovariate(0.3), rnd.paretovariate(0.2), 1e300, -1.0]), "n": n})
    values = [rnd.choice([rnd.gauss(0, 2), rnd.gauss(0, 1e6), 5 + rnd.randint(0, 700) * 1e-6, 0.0, -0.0, 1e300]) for _ in range(250)] + [None, float("inf")]
    rows = [{"i": i, "v": v} for i, v in enumerate(values)]
    met, reduced = [], L._reduced

    def counted(df, keys, best, other):
        if keys == ["_ask"]:
            met.append((df.count(), df.select("_ask").distinct().count()))
        return reduced(df, keys, best, other)

    monkeypatch.setattr(L, "_reduced", counted)
    for low, high in ((">=", "<="), (">", "<")):
        got, want = both(spark, rows, bands, "i int, v double", "lo double, hi double, n int", [("v", low, "lo"), ("v", high, "hi")], policy)
        assert got == want
    points = 250 + 2 * 700
    levels = next(l for l in range(30) if 4 ** l > points)
    assert all(rows_met <= levels * asked for rows_met, asked in met) and met


@pytest.mark.parametrize("policy, ops", [("First", (">=", "<=", ">=", "<")), ("Last", (">", "<", ">=", "<=")), ("Any", (">=", "<=", ">", None)), ("First", (None, "<", ">=", None))])
def test_two_ranges_and_a_key(spark, policy, ops):
    rnd, day = random.Random(9), lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n)
    bands = []
    for n in range(160):
        start, least = rnd.randint(0, 60), rnd.choice([rnd.randint(0, 20), rnd.uniform(0, 20)])
        bands.append({"g": rnd.choice(["a", "b", None]), "since": rnd.choice([day(start)] * 9 + [datetime.date(1900, 1, 1), None]),
                      "until": rnd.choice([day(start + rnd.choice([0, 1, 30, -2]))] * 9 + [datetime.date(9999, 12, 31)]), "least": float(least), "most": float(least + rnd.choice([0, 1, 15])), "n": n})
    rows = [{"i": i, "k": rnd.choice(["a", "a", "b", "c", None]), "d": rnd.choice([day(rnd.randint(-2, 95)), None]), "x": rnd.choice([float(rnd.randint(-1, 30)), rnd.uniform(0, 30)])} for i in range(220)]
    on = [("k", "=", "g"), *[(o, op, t) for o, op, t in zip(("d", "d", "x", "x"), ops, ("since", "until", "least", "most")) if op]]
    got, want = both(spark, rows, bands, "i int, k string, d date, x double", "g string, since date, until date, least double, most double, n int", on, policy)
    assert got == want and any(n is not None for _, n in got)


@pytest.mark.parametrize("policy", ["First", "Last", "Any"])
@pytest.mark.parametrize("on", [[("k", "=", "g"), ("s", "<>", "t")], [("s", "!=", "t")], [("x", ">=", "lo"), ("x", "<", "hi"), ("s", "<>", "t")]])
def test_unlike(spark, policy, on):
    rnd = random.Random(3)
    bands = [{"g": rnd.choice([1, 2, 3, None]), "t": rnd.choice(["p", "q", None] if n > 5 else ["p"]), "lo": float(rnd.randint(0, 9)), "hi": float(rnd.randint(0, 20)), "n": n} for n in range(60)]
    bands += [{"g": 7, "t": "p", "lo": 30.0, "hi": 40.0, "n": 100 + n} for n in range(3)]       # one value only
    rows = [{"i": i, "k": rnd.choice([1, 2, 3, 4, 7, None]), "s": rnd.choice(["p", "q", "r", None]), "x": float(rnd.choice([*range(-1, 12), 35]))} for i in range(80)]
    on_plain = [(o, "<>" if op == "!=" else op, t) for o, op, t in on]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "i int, k int, s string, x double")
    table = spark.createDataFrame([tuple(b.values()) for b in bands], "g int, t string, lo double, hi double, n int")
    out = L.lookup_where(df, table, on, {"n": "n", "t": "t"}, policy, ["n"])
    got = sorted(((r["i"], r["n"]) for r in out.collect()), key=str)
    if policy == "Any":  # any match will do, but a match there must be
        want = dict(brute(rows, bands, on_plain, "First"))
        matches = {r["i"]: {b["n"] for b in bands if all(r[o] is not None and b[t] is not None and HOLDS[op](r[o], b[t]) for o, op, t in on_plain)} for r in rows}
        assert len(got) == len(rows) and all((n is None) == (want[i] is None) and (n is None or n in matches[i]) for i, n in got)
    else:
        assert got == brute(rows, bands, on_plain, policy)
    assert out.count() == len(rows) and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_and_mixed_types_have_ranges(spark):
    df = spark.createDataFrame([(1, "apple", 3), (2, "pear", 10), (3, "zebra", 12)], "i int, s string, v int")
    table = spark.createDataFrame([("a", "m", 2.5, 3.0, 1), ("n", "z", 9.5, 10.0, 2)], "lo string, hi string, dlo double, dhi double, n int")
    by_text = L.lookup_where(df, table, [("s", ">=", "lo"), ("s", "<=", "hi")], {"n": "n"}, order_by=["n"])
    by_number = L.lookup_where(df, table, [("v", ">", "dlo"), ("v", "<=", "dhi")], {"n": "n"}, order_by=["n"])
    assert [r["n"] for r in by_text.orderBy("i").collect()] == [r["n"] for r in by_number.orderBy("i").collect()] == [1, 2, None]


def test_empty_sides_and_refused_conditions(spark):
    df, table = spark.createDataFrame([(1, 2.0)], "i int, v double"), spark.createDataFrame([(1.0, 3.0, 1)], "lo double, hi double, n int")
    on = [("v", ">=", "lo"), ("v", "<=", "hi")]
    assert L.lookup_where(df, table.limit(0), on, {"n": "n"}, order_by=["n"]).first()["n"] is None
    assert L.lookup_where(df.limit(0), table, on, {"n": "n"}, order_by=["n"]).count() == 0
    for bad in ([], on + on[:1], [("v", "<>", "lo"), ("v", "<>", "hi")], [("v", "~", "lo")]):
        with pytest.raises(ValueError):
            L.lookup_where(df, table, bad, {"n": "n"}, order_by=["n"])
    with pytest.raises(ValueError, match="order_by"):
        L.lookup_where(df, table, on, {"n": "n"}, "Last")


KINDS = {J.NORMAL: (False, False), J.DETAIL_OUTER: (True, False), J.MASTER_OUTER: (False, True), J.FULL_OUTER: (True, True)}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("cond", [
    [("lo", "<=", "v"), ("hi", ">", "v")],
    [("lo", "<", "v"), ("a", "<>", "b")],
    [("a", ">=", "b"), ("a", "<", "v"), ("hi", ">", "b")]])
def test_join_without_equality(spark, kind, cond):
    """hot and repeated values, bands of any width, NULLs, empty bands; all join types against brute force"""
    rnd = random.Random(3)
    some = lambda: rnd.choice([None, 7.0, 7.0, rnd.uniform(0, 20), rnd.gauss(0, 1e5), -0.0])
    master = [(i, rnd.randint(0, 9), lo, None if lo is None else lo + rnd.choice([0.0, 0.5, 1e9, -1.0])) for i in range(90) for lo in [some()]]
    detail = [(j, rnd.randint(0, 9), some()) for j in range(80)]
    at, there = {"a": 1, "lo": 2, "hi": 3}, {"b": 1, "v": 2}
    holds = lambda m, d: all(m[at[x]] is not None and d[there[y]] is not None and HOLDS[op](m[at[x]], d[there[y]]) for x, op, y in cond)
    want = [(m[0], d[0]) for m in master for d in detail if holds(m, d)]
    hit_m, hit_d = {m for m, _ in want}, {d for _, d in want}
    keep_m, keep_d = KINDS[kind]
    want += [(m[0], None) for m in master if keep_m and m[0] not in hit_m] + [(None, d[0]) for d in detail if keep_d and d[0] not in hit_d]
    out = J.joiner(spark.createDataFrame(master, "i int, a int, lo double, hi double"), spark.createDataFrame(detail, "j int, b int, v double"), cond, kind)
    assert out.columns == ["i", "a", "lo", "hi", "j", "b", "v"]
    assert sorted(((r["i"], r["j"]) for r in out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_join_without_equality_on_empty_tables(spark):
    master, detail = spark.createDataFrame([], "i int, lo double"), spark.createDataFrame([(1, 2.0)], "j int, v double")
    assert J.joiner(master, detail, [("lo", "<", "v")]).count() == 0
    assert J.joiner(master, detail, [("lo", "<", "v")], J.MASTER_OUTER).collect() == [(None, None, 1, 2.0)]
    with pytest.raises(ValueError, match="equality or a range"):
        J.joiner(master, detail, [("i", "<>", "j")])


def test_ranges_meet_no_row_beyond_the_answer(spark):
    """one cell a pair, so the join on cells gives each pair once"""
    values = spark.createDataFrame([(float(i % 300),) for i in range(600)], "_v0 double")
    bands = spark.createDataFrame([(float(i), float(i + i % 50)) for i in range(300)], "_low0 double, _high0 double")
    pairs = [tuple(r) for r in L.range_pairs(values, bands, {"low": False, "high": False}).collect()]
    assert len(pairs) == len(set(pairs)) == sum(min(299, i + i % 50) - i + 1 for i in range(300))


def test_bands_are_dealt_by_number_before_they_are_tiled(spark, monkeypatch):
    """A task tiles a bounded number of bands; before, it tiled what AQE had merged by the bytes of the thin bands."""
    from weftwork.operators import lookups

    dealt = []
    real = lookups._dealt
    monkeypatch.setattr(lookups, "BANDS_A_TASK", 5)
    monkeypatch.setattr(lookups, "_dealt", lambda df, count: dealt.append((count, real(df, count).rdd.getNumPartitions())) or real(df, count))
    bands = spark.range(100).selectExpr("id", "id * 3 AS lo", "id * 3 + id % 7 AS hi")
    asked = spark.range(0, 400, 7).selectExpr("id AS v")
    out = lookups.range_lookup(asked, bands, "v", "lo", "hi", None, {"band": "id"}, policy="First", order_by=["id"])
    want = {v: min((i for i in range(100) if i * 3 <= v <= i * 3 + i % 7), default=None) for v in range(0, 400, 7)}
    assert {r.v: r.band for r in out.collect()} == want and dealt == [(100, 20)]
    pairs = lookups.range_pairs(asked.selectExpr("v AS _v0"), bands.selectExpr("lo AS _low0", "hi AS _high0"), {"low": False, "high": False})
    assert pairs.count() == sum(i * 3 <= v <= i * 3 + i % 7 for v in range(0, 400, 7) for i in range(100)) and dealt == [(100, 20)] * 2


@pytest.mark.parametrize("ops", [(">=", "<=", ">", None), (None, "<", ">=", "<="), (">", None, None, "<")])
def test_ranks_of_the_first_of_two_ranges_follow_distinct_values(spark, monkeypatch, ops):
    """before, each row and band had ranks of its own, so rows and tiles were multiplied by levels that grow with the rows"""
    rnd, last, dealt = random.Random(4), [], L._dealt
    monkeypatch.setattr(L, "_dealt", lambda bands, count: (last.append(bands.agg({"_last": "max"}).first()[0]), dealt(bands, count))[1])
    rows = [{"i": i, "d": rnd.choice([1, 2, 5, None]), "x": rnd.uniform(0, 30)} for i in range(200)]
    bands = [{"since": rnd.choice([1, 2, 4, None]), "until": rnd.choice([1.0, 4.5, 9.0]), "least": rnd.uniform(0, 30), "most": rnd.uniform(0, 30), "n": n} for n in range(150)]
    on = [(o, op, t) for o, op, t in zip(("d", "d", "x", "x"), ops, ("since", "until", "least", "most")) if op]
    got, want = both(spark, rows, bands, "i int, d int, x double", "since int, until double, least double, most double, n int", on, "Last")
    assert got == want and any(n is not None for _, n in got)
    assert len(last) == 2 and last[0] < 3 + 2 * 3 < last[1]
