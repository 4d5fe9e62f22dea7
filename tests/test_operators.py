"""NULLs, ties, many matches, empty inputs and skewed keys that the given tables do not contain."""

import random

import pytest
from pyspark.sql import functions as F

from weftwork.operators import aggregates as A
from weftwork.operators import joins as J
from weftwork.operators import lookups as L
from weftwork.operators import rows as R
from weftwork.operators import sets
from weftwork.operators import windows as W
from weftwork.operators.keys import dense_index
from weftwork.operators.udf import procedure, row_code

c = F.col


def test_filter_drops_null_condition(spark, rows):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, ok boolean")
    assert rows(R.keep_true(df, "ok"), "id") == [(2,)]


def test_router_sends_a_row_to_every_true_group_and_null_to_default(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, v int")
    groups = {"A": c("v") > 1, "B": c("v") > 10}
    parts = R.route(df, groups, "D")
    assert rows(parts["A"], "id") == [(1,), (2,)] and rows(parts["B"], "id") == [(2,)] and rows(parts["D"], "id") == [(3,)]
    assert rows(R.tag_groups(df, groups, "D"), "ROUTE", "id") == [("A", 1), ("A", 2), ("B", 2), ("D", 3)]


def test_normalizer_keeps_nulls_and_pads_uneven_fields(spark, rows):
    df = spark.createDataFrame([(7, 1, None, 3, "x", "y")], "k int, a1 int, a2 int, a3 int, b1 string, b2 string")
    out = R.normalize(df, {"k": ["k"], "a": ["a1", "a2", "a3"], "b": ["b1", "b2"]}, gcid=True)
    assert rows(out, "k", "a", "GCID_a", "b") == [(7, 1, 1, "x"), (7, 3, 3, None), (7, None, 2, "y")]


def test_variables_do_not_leave_the_step(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = R.with_variables(df, [("v", c("a") + 1), ("out", c("v") * 2)], ["out"])
    assert out.columns == ["a", "out"] and out.first()["out"] == 4


def test_dense_index_has_no_gaps_over_many_partitions(spark):
    df = spark.range(0, 10000, numPartitions=7).withColumn("hot", F.lit("same"))
    out = dense_index(df, ["hot", c("id").desc()], "n", start=5, step=2)
    got = {r["id"]: r["n"] for r in out.collect()}
    assert got == {i: 5 + 2 * (9999 - i) for i in range(10000)}


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.range(0), ["id"], "n").count() == 0


def _sides(spark):
    return (spark.createDataFrame([(1, "m1"), (2, "m2"), (None, "mn")], "mk int, mv string"),
            spark.createDataFrame([(1, "d1"), (1, "d1b"), (3, "d3"), (None, "dn")], "dk int, dv string"))


@pytest.mark.parametrize("kind, want", [
    (J.NORMAL, [("m1", "d1"), ("m1", "d1b")]),
    (J.MASTER_OUTER, [("m1", "d1"), ("m1", "d1b"), (None, "d3"), (None, "dn")]),
    (J.DETAIL_OUTER, [("m1", "d1"), ("m1", "d1b"), ("m2", None), ("mn", None)]),
    (J.FULL_OUTER, [("m1", "d1"), ("m1", "d1b"), ("m2", None), ("mn", None), (None, "d3"), (None, "dn")])])
def test_join_kinds(spark, rows, kind, want):
    assert rows(J.joiner(*_sides(spark), [("mk", "=", "dk")], kind), "mv", "dv") == want


def test_join_by_inequality_alone_is_refused(spark):
    """ranges join without an equality (see test_conditions); <> alone asks for nearly all pairs"""
    with pytest.raises(ValueError):
        J.joiner(*_sides(spark), [("mk", "<>", "dk")])


@pytest.mark.parametrize("sub, want", [([1], [2]), ([1, None], []), ([], [1, 2, None])])
def test_not_in_follows_sql_nulls(spark, sub, want):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    side = spark.createDataFrame([(x,) for x in sub], "s int")
    got = [r["k"] for r in J.not_in(df, "k", side, "s").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lookup_never_multiplies_and_misses_are_null(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    table = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3)], "tk int, v string, o int")
    for policy, value in (("First", "a"), ("Last", "c"), ("Any", "a")):
        out = L.lookup(df, table, [("k", "tk")], {"v": "v"}, policy, ["o"])
        assert rows(out, "k", "v") == [(1, value), (1, value), (2, None), (None, None)]


def test_lookup_keeps_a_null_output_of_the_first_match(spark):
    df = spark.createDataFrame([(1,)], "k int")
    table = spark.createDataFrame([(1, None, 1), (1, "x", 2)], "tk int, v string, o int")
    assert L.lookup(df, table, [("k", "tk")], {"v": "v"}, "First", ["o"]).first()["v"] is None


@pytest.mark.parametrize("seed, low_open, high_open, policy, cell", [
    (1, False, False, "First", 1.0), (2, True, False, "Last", 0.5), (3, False, True, "First", 7.0), (4, True, True, "Last", 1000.0)])
def test_range_lookup_equals_brute_force(spark, seed, low_open, high_open, policy, cell):
    rnd = random.Random(seed)
    bands = []
    for i in range(300):
        low = rnd.choice([rnd.uniform(-500, 500), rnd.randint(-50, 50), 0.0])
        bands.append((rnd.choice("ab"), float(low), float(low + rnd.choice([0, 1, 5, 300, 5000, -1])), i))
    values = [(rnd.choice("abc"), rnd.choice([float(rnd.randint(-60, 60)), rnd.uniform(-600, 900), 0.0])) for _ in range(400)] + [("a", None)]
    df = spark.createDataFrame(values, "g string, v double")
    table = spark.createDataFrame(bands, "bg string, lo double, hi double, n int")
    out = L.range_lookup(df, table, "v", "lo", "hi", cell, {"n": "n"}, [("g", "bg")], policy, ["n"], low_open, high_open)

    def brute(g, v):
        hits = [n for bg, lo, hi, n in bands if v is not None and bg == g and (lo < v if low_open else lo <= v) and (v < hi if high_open else v <= hi)]
        return (min if policy == "First" else max)(hits) if hits else None

    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((g, v, brute(g, v))) for g, v in values)


def test_only_new(spark, rows):
    df, target = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "t int")
    assert rows(L.only_new(df, target, [("k", "t")])) == [(1,)]


@pytest.mark.parametrize("seed", range(3))
def test_percentile_equals_brute_force_on_a_skewed_key(spark, seed):
    rnd = random.Random(seed)
    data = [("hot", rnd.lognormvariate(0, 3)) for _ in range(20000)] + [(k, float(rnd.randint(0, 3))) for k in ["b", None] for _ in range(50)]
    data += [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {"p0": 0, "p50": 50, "p95": 95, "p99": 99, "p100": 100}
    got = {r["k"]: tuple(r[n] for n in wanted) for r in A.percentile_nearest_rank(df, ["k"], "v", wanted).collect()}
    want = {}
    for key in {k for k, v in data if v is not None}:
        vs = sorted(v for k, v in data if k == key and v is not None)
        want[key] = tuple(vs[max(1, min(-int(-(p / 100.0 * len(vs)) // 1), len(vs))) - 1] for p in wanted.values())
    assert got == want


def test_percentile_of_the_whole_table(spark):
    df = spark.createDataFrame([(3.5,), (8.25,)], "v double")
    assert tuple(A.percentile_nearest_rank(df, [], "v", {"p50": 50, "p95": 95}).first()) == (3.5, 8.25)


def test_global_aggregate_of_nothing_is_one_row(spark):
    assert tuple(A.aggregate(spark.range(0), [], {"n": A.count_(), "s": A.sum_(c("id"))}).first()) == (0, None)


def test_passthrough_takes_the_last_row(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, o int, v string")
    assert rows(A.aggregate(df, ["k"], {"n": A.count_()}, ["v"], ["o"])) == [("a", 2, None), ("b", 1, "z")]


def test_duplicates_with_null_keys(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4), (2, 5)], "k int, o int")
    first, again = W.split_duplicates(df, ["k"], ["o"])
    assert rows(first, "o") == [(1,), (3,), (5,)] and rows(again, "o") == [(2,), (4,)]


def test_first_and_latest(spark, rows):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None)], "k string, o int, v string")
    assert rows(W.first_by(df, ["k"], ["v"], ["o"])) == [("a", "x"), ("b", None)]
    assert rows(W.latest_per_key(df, ["k"], ["v"], ["o"])) == [("a", "y"), ("b", None)]


def test_union_maps_names_and_keeps_the_rest(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "i1 int, t string"), spark.createDataFrame([(2,)], "i2 int")
    out = sets.union_groups({"A": a, "B": b}, {"A": {"i1": "i"}, "B": {"i2": "i"}})
    assert rows(out, "i", "t") == [(1, "x"), (2, None)]


def test_row_code_may_emit_nothing(spark):
    assert row_code(spark.range(5), lambda r: iter(()), "id bigint").count() == 0


def test_procedure_with_pandas_function(spark, rows):
    out = procedure(spark.range(3), lambda s: s * 2.0, ["id"], "RET", "double")
    assert rows(out, "id", "RET") == [(0, 0.0), (1, 2.0), (2, 4.0)]


def test_parameters_are_bound_not_pasted(spark, rows):
    df = spark.createDataFrame([("a' OR 'x",), ("b",)], "s string")
    assert rows(R.parametrised_sql(spark, "SELECT s FROM {t} WHERE s = $$P", {"P": "a' OR 'x"}, t=df)) == [("a' OR 'x",)]


def brute_range(values, bands, low_open=False, high_open=False):
    """the first band by id of each value"""
    return {v: min((i for i, lo, hi in bands if (lo is None or lo < v or lo == v and not low_open) and (hi is None or v < hi or v == hi and not high_open)), default=None) for v in values}


@pytest.mark.parametrize("cell", [None, 1e-3, 16.0, 1e12])
def test_range_lookup_at_the_ends_of_the_line(spark, cell):
    bands = [(1, -9e18, 9e18), (2, 0.0, 9e18), (3, 0.1, 0.2), (4, 0.15, 0.15), (5, -1e300, -1e290), (6, 5.0, 4.0), (0, 0.12, 0.17)]
    values = [5.0, 2e18, -8.9e18, 0.15, 0.1, 0.2, -1e295, 1e300, 0.16999, 4.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    table = spark.createDataFrame(bands, "i int, lo double, hi double")
    for flags in ({}, {"low_open": True, "high_open": True}):
        got = {r["v"]: r["i"] for r in L.range_lookup(df, table, "v", "lo", "hi", cell, {"i": "i"}, order_by=["i"], **flags).collect()}
        assert got == brute_range(values, bands, **flags)
    got = {r["v"]: r["i"] for r in L.range_lookup(df, table, "v", None, "hi", cell, {"i": "i"}, order_by=["i"]).collect()}
    assert got == brute_range(values, [(i, None, hi) for i, _, hi in bands])
    got = {r["v"]: r["i"] for r in L.range_lookup(df, table, "v", "lo", None, cell, {"i": "i"}, order_by=["i"], low_open=True).collect()}
    assert got == brute_range(values, [(i, lo, None) for i, lo, _ in bands], low_open=True)


def test_range_lookup_over_dates_and_times(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'1999-12-31 23:59:58', TIMESTAMP_NTZ'2000-01-01 00:00:03', INTERVAL 1 SECOND)) AS v")
    table = spark.sql("SELECT * FROM VALUES (2, TIMESTAMP_NTZ'1900-01-01 00:00:00', TIMESTAMP_NTZ'9999-12-31 00:00:00'), (1, TIMESTAMP_NTZ'2000-01-01 00:00:00', TIMESTAMP_NTZ'2000-01-01 00:00:01.5') AS t(i, lo, hi)")
    assert [r["i"] for r in L.range_lookup(df, table, "v", "lo", "hi", None, {"i": "i"}, order_by=["i"]).orderBy("v").collect()] == [2, 2, 1, 1, 2, 2]


def test_equal_rows_are_duplicates(spark):
    df = spark.createDataFrame([(1, "a")] * 2 + [(2, None)] * 3000 + [(2, "b")], "k int, v string")
    got = {(r["k"], r["v"], r["f"]): r["n"] for r in W.flag_duplicates(df, ["k"], ["k"], "f").groupBy("k", "v", "f").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "a", "N"): 1, (1, "a", "Y"): 1, (2, None, "N"): 1, (2, None, "Y"): 2999, (2, "b", "Y"): 1}


def test_percentile_band_stays_narrow_with_repeated_values(spark):
    """nine rows of ten on ten values: exact, and nothing but the band is ordered"""
    df = spark.range(200_000).select(F.when(F.col("id") % 10 < 9, F.col("id") % 10).otherwise(F.col("id") / 7.0 + 5).alias("v"))
    values = sorted(r["v"] for r in df.collect())
    wanted = {"p5": 5, "p50": 50, "p95": 95, "p99": 99}
    got = A.percentile_nearest_rank(df, [], "v", wanted).first()
    assert tuple(got) == tuple(values[-(-len(values) * p // 100) - 1] for p in wanted.values())
