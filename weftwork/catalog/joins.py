"""Queries for joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog.registry import query
from weftwork.operators import joins as J
from weftwork.operators import lookups as L
from weftwork.sources.tables import source_sql

c = F.col

# Whole tables; the keys of one market segment and of some orders are shifted away, so both sides have unmatched rows.
_MASTER = "(SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN -1 - c_custkey ELSE c_custkey END AS c_custkey, c_name, c_acctbal FROM customer)"
_DETAIL = "(SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1000000000 + o_custkey ELSE o_custkey END AS o_custkey, o_totalprice FROM orders)"


def _sides(t):
    master = t.customer.select(F.when(c("c_mktsegment") == "BUILDING", -1 - c("c_custkey")).otherwise(c("c_custkey")).alias("c_custkey"), "c_name", "c_acctbal")
    detail = t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "P", 1000000000 + c("o_custkey")).otherwise(c("o_custkey")).alias("o_custkey"), "o_totalprice")
    return master, detail


def _joined(name: str, kind: str, sql_kind: str) -> None:
    @query(name, f"SELECT * FROM {_MASTER} m {sql_kind} JOIN {_DETAIL} d ON c_custkey = o_custkey")
    def run(t):
        return J.joiner(*_sides(t), [("c_custkey", "=", "o_custkey")], kind)


_joined("normal", J.NORMAL, "INNER")
_joined("master_outer", J.MASTER_OUTER, "RIGHT")
_joined("detail_outer", J.DETAIL_OUTER, "LEFT")
_joined("full_outer", J.FULL_OUTER, "FULL")


@query("multi_condition", f"""
SELECT * FROM {_MASTER} m JOIN {_DETAIL} d ON c_custkey = o_custkey AND c_acctbal * 1 <= o_totalprice AND c_custkey <> o_orderkey""")
def multi_condition(t):
    return J.joiner(*_sides(t), [("c_custkey", "=", "o_custkey"), ("c_acctbal", "<=", "o_totalprice"), ("c_custkey", "^=", "o_orderkey")])


# Prices in narrow bands, in open ones and in none; no column is equal to another.
_BANDS = """(SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_retailprice * 100 END AS lo, p_retailprice * 100 + p_size AS hi FROM part)"""
_PRICES = "(SELECT o_orderkey, o_totalprice FROM orders)"


def _banded(name: str, kind: str, sql_kind: str) -> None:
    @query(name, f"SELECT * FROM {_BANDS} m {sql_kind} JOIN {_PRICES} d ON lo <= o_totalprice AND hi > o_totalprice AND p_partkey <> o_orderkey")
    def run(t):
        bands = t.part.select("p_partkey", F.when(c("p_partkey") % 40 != 0, c("p_retailprice") * 100).alias("lo"), (c("p_retailprice") * 100 + c("p_size")).alias("hi"))
        return J.joiner(bands, t.orders.select("o_orderkey", "o_totalprice"),
                        [("lo", "<=", "o_totalprice"), ("hi", ">", "o_totalprice"), ("p_partkey", "^=", "o_orderkey")], kind)


_banded("inequality_join", J.NORMAL, "INNER")
_banded("inequality_full_outer", J.FULL_OUTER, "FULL")


@query("user_defined_join", """
SELECT n_name, s_name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem, supplier, nation
WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey GROUP BY 1, 2""")
def user_defined_join(t):
    li, s, n = t.lineitem, t.supplier, t.nation
    joined = J.source_join([li, s, n], [li["l_suppkey"] == s["s_suppkey"], s["s_nationkey"] == n["n_nationkey"]])
    return joined.groupBy("n_name", "s_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("not_in_subquery", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)""")
def not_in_subquery(t):
    return J.not_in(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.filter("c_acctbal < 5000"), "c_custkey")


@query("in_subquery", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)""")
def in_subquery(t):
    return J.in_subquery(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.filter("c_acctbal < 5000"), "c_custkey")


def _match(policy: str, extra: str = "") -> str:
    pick = {"First": "arg_min({0}, (o_orderdate, o_orderkey))", "Last": "arg_max({0}, (o_orderdate, o_orderkey))"}[policy]
    return (f"(SELECT o_custkey, {pick.format('o_orderkey')} AS ok, {pick.format('o_totalprice')} AS tp, "
            f"{pick.format('o_orderstatus')} AS st FROM orders {extra} GROUP BY o_custkey)")


_ORDER = ["o_orderdate", "o_orderkey"]


def _customers(t):
    return t.customer.select("c_custkey", "c_name")


@query("connected", f"SELECT c_custkey, c_name, ok AS first_order FROM customer LEFT JOIN {_match('First', 'WHERE o_totalprice > 400000')} o ON c_custkey = o_custkey")
def connected(t):
    return L.lookup(_customers(t), t.orders.filter("o_totalprice > 400000"), [("c_custkey", "o_custkey")], {"first_order": "o_orderkey"}, "First", _ORDER)


@query("multi_output", f"SELECT c_custkey, c_name, ok, tp, st FROM customer LEFT JOIN {_match('First')} o ON c_custkey = o_custkey")
def multi_output(t):
    return L.lookup(_customers(t), t.orders, [("c_custkey", "o_custkey")],
                    {"ok": "o_orderkey", "tp": "o_totalprice", "st": "o_orderstatus"}, "First", _ORDER)


@query("unconnected", f"""
SELECT c_custkey, CASE WHEN tp IS NULL THEN -1 ELSE round(tp * 2, 2) END AS doubled FROM customer
LEFT JOIN {_match('First', 'WHERE o_totalprice > 400000')} o ON c_custkey = o_custkey""")
def unconnected(t):
    value = lambda v: F.when(v.isNull(), F.lit(-1.0)).otherwise(F.round(v * 2, 2))
    return L.lookup_value(t.customer.select("c_custkey"), "doubled", t.orders.filter("o_totalprice > 400000"),
                          [("c_custkey", "o_custkey")], "o_totalprice", value, "First", _ORDER)


# Whole orders; those of each fifth customer have keys shifted away, so that customer misses.
_AWAY = """(SELECT CASE WHEN o_custkey % 5 = 0 THEN 1000000000 + o_custkey ELSE o_custkey END AS o_custkey, o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders)"""
_FIRST_AWAY = _match("First").replace("FROM orders", f"FROM {_AWAY} w")


def _away(t):
    return t.orders.withColumn("o_custkey", F.when(c("o_custkey") % 5 == 0, 1000000000 + c("o_custkey")).otherwise(c("o_custkey")))


@query("connected_all", f"SELECT c_custkey, c_name, ok AS first_order FROM customer LEFT JOIN {_FIRST_AWAY} o ON c_custkey = o_custkey")
def connected_all(t):
    """`connected` over whole orders."""
    return L.lookup(_customers(t), _away(t), [("c_custkey", "o_custkey")], {"first_order": "o_orderkey"}, "First", _ORDER)


@query("unconnected_all", f"""
SELECT c_custkey, CASE WHEN tp IS NULL THEN -1 ELSE round(tp * 2, 2) END AS doubled FROM customer LEFT JOIN {_FIRST_AWAY} o ON c_custkey = o_custkey""")
def unconnected_all(t):
    """`unconnected` over whole orders."""
    value = lambda v: F.when(v.isNull(), F.lit(-1.0)).otherwise(F.round(v * 2, 2))
    return L.lookup_value(t.customer.select("c_custkey"), "doubled", _away(t), [("c_custkey", "o_custkey")], "o_totalprice", value, "First", _ORDER)


@query("match_first", f"SELECT c_custkey, c_name, ok, tp FROM customer LEFT JOIN {_match('First')} o ON c_custkey = o_custkey")
def match_first(t):
    return L.lookup(_customers(t), t.orders, [("c_custkey", "o_custkey")], {"ok": "o_orderkey", "tp": "o_totalprice"}, "First", _ORDER)


@query("match_last", f"SELECT c_custkey, c_name, ok, tp FROM customer LEFT JOIN {_match('Last')} o ON c_custkey = o_custkey")
def match_last(t):
    return L.lookup(_customers(t), t.orders, [("c_custkey", "o_custkey")], {"ok": "o_orderkey", "tp": "o_totalprice"}, "Last", _ORDER)


@query("match_any", "SELECT c_custkey, c_name, ok FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS ok FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def match_any(t):
    return L.lookup(_customers(t), t.orders, [("c_custkey", "o_custkey")], {"ok": "o_orderkey"}, "Any")


@query("lookup_source_filter", f"""
SELECT c_custkey, c_name, ok FROM customer LEFT JOIN {_match('First', "WHERE o_orderstatus = 'P'")} o ON c_custkey = o_custkey""")
def lookup_source_filter(t):
    return L.lookup(_customers(t), t.orders, [("c_custkey", "o_custkey")], {"ok": "o_orderkey"}, "First", _ORDER, "o_orderstatus = 'P'")


@query("sql_override", """
SELECT c_custkey, total FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o_custkey""")
def sql_override(t):
    side = source_sql(t.spark, "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey",
                      {"orders": t.orders})
    return L.lookup(t.customer.select("c_custkey"), side, [("c_custkey", "o_custkey")], {"total": "total"}, "Any")


# Overlapping price bands of very different widths, from the parts table.
_BANDS = """(SELECT p_partkey, p_brand, (p_partkey * 37) % 5000 * 100.0 AS lo,
  (p_partkey * 37) % 5000 * 100.0 + 50.0 * p_size * (p_partkey % 7) AS hi FROM part)"""


def _bands(t):
    start = (c("p_partkey") * 37) % 5000 * 100.0
    return t.part.select("p_partkey", "p_brand", start.alias("lo"), (start + 50.0 * c("p_size") * (c("p_partkey") % 7)).alias("hi"))


@query("theta_condition", f"""
SELECT o_orderkey, o_totalprice, arg_min(p_brand, p_partkey) AS brand, min(p_partkey) AS band
FROM orders LEFT JOIN {_BANDS} b ON o_totalprice BETWEEN lo AND hi GROUP BY 1, 2""")
def theta_condition(t):
    return L.range_lookup(t.orders.select("o_orderkey", "o_totalprice"), _bands(t), "o_totalprice", "lo", "hi", 16.0,
                          {"brand": "p_brand", "band": "p_partkey"}, policy="First", order_by=["p_partkey"])


_DAYS = """(SELECT s_suppkey, CASE WHEN s_suppkey % 25 = 0 THEN DATE '1900-01-01' ELSE CAST(DATE '1995-01-01' + CAST(s_suppkey * 23 AS INT) AS DATE) END AS lo,
  CASE WHEN s_suppkey % 40 = 0 THEN DATE '9999-12-31' ELSE CAST(DATE '1995-01-01' + CAST(s_suppkey * 23 + s_suppkey % 90 AS INT) AS DATE) END AS hi FROM supplier)"""


@query("theta_condition_dates", f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, max(s_suppkey) AS last_band FROM orders LEFT JOIN {_DAYS} b ON CAST(o_orderdate AS DATE) BETWEEN lo AND hi GROUP BY 1, 2""")
def theta_condition_dates(t):
    """Bands of days, some of them open by sentinel dates."""
    first = F.lit("1995-01-01").cast("date")
    bands = t.supplier.select("s_suppkey", F.when(c("s_suppkey") % 25 == 0, F.lit("1900-01-01").cast("date")).otherwise(F.date_add(first, (c("s_suppkey") * 23).cast("int"))).alias("lo"),
                              F.when(c("s_suppkey") % 40 == 0, F.lit("9999-12-31").cast("date")).otherwise(
                                  F.date_add(first, (c("s_suppkey") * 23 + c("s_suppkey") % 90).cast("int"))).alias("hi"))
    orders = t.orders.select("o_orderkey", c("o_orderdate").cast("date").alias("day"))
    return L.range_lookup(orders, bands, "day", "lo", "hi", None, {"last_band": "s_suppkey"}, policy="Last", order_by=["s_suppkey"])


_LIMITS = """(SELECT p_partkey, CASE WHEN p_partkey % 500 = 0 THEN -9e18 ELSE p_retailprice * 100 END AS lo, CASE WHEN p_partkey % 700 = 0 THEN 9e18 ELSE p_retailprice * 100 + p_partkey END AS hi FROM part)"""


@query("theta_condition_limits", f"""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN -8e18 WHEN 1 THEN 8.5e18 WHEN 2 THEN o_totalprice / 1e6 ELSE o_totalprice END AS x FROM orders)
SELECT o_orderkey, x, (SELECT min(p_partkey) FROM {_LIMITS} b WHERE x BETWEEN lo AND hi) AS band, (SELECT max(p_partkey) FROM {_LIMITS} b WHERE x < hi) AS below FROM v""")
def theta_condition_limits(t):
    """Values and bands far outside the usual numbers, and a range with one bound."""
    bands = t.part.select("p_partkey", F.when(c("p_partkey") % 500 == 0, F.lit(-9e18)).otherwise(c("p_retailprice") * 100).alias("lo"),
                          F.when(c("p_partkey") % 700 == 0, F.lit(9e18)).otherwise(c("p_retailprice") * 100 + c("p_partkey")).alias("hi"))
    k = c("o_orderkey") % 9
    orders = t.orders.select("o_orderkey", F.when(k == 0, F.lit(-8e18)).when(k == 1, F.lit(8.5e18)).when(k == 2, c("o_totalprice") / 1e6).otherwise(c("o_totalprice")).alias("x"))
    both = L.range_lookup(orders, bands, "x", "lo", "hi", None, {"band": "p_partkey"}, policy="First", order_by=["p_partkey"])
    return L.range_lookup(both, bands, "x", None, "hi", 64.0, {"below": "p_partkey"}, policy="Last", order_by=["p_partkey"], high_open=True)


# Price lists with a validity and an amount range: sentinel ends, widths from nothing to everything.
_OFFERS = """(SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_partkey % 50 = 0 THEN DATE '1900-01-01' ELSE CAST(DATE '1992-01-01' + CAST((p_partkey * 37) % 2600 AS INT) AS DATE) END AS since,
  CASE WHEN p_partkey % 60 = 0 THEN DATE '9999-12-31' WHEN p_partkey % 90 = 1 THEN NULL
    ELSE CAST(DATE '1992-01-01' + CAST((p_partkey * 37) % 2600 + p_size * (p_partkey % 11) AS INT) AS DATE) END AS until,
  CASE WHEN p_partkey % 70 = 0 THEN -1e300 ELSE (p_partkey * 91) % 4000 * 100.0 END AS least, (p_partkey * 91) % 4000 * 100.0 + 400.0 * p_size * (p_partkey % 5) AS most FROM part)"""


def _offers(t):
    first, key = F.lit("1992-01-01").cast("date"), c("p_partkey")
    start, amount = (key * 37) % 2600, (key * 91) % 4000 * 100.0
    return t.part.select(key.alias("id"), c("p_brand").alias("brand"), F.when(key % 50 == 0, F.lit("1900-01-01").cast("date")).otherwise(F.date_add(first, start.cast("int"))).alias("since"),
                         F.when(key % 60 == 0, F.lit("9999-12-31").cast("date")).when(key % 90 == 1, None).otherwise(
                             F.date_add(first, (start + c("p_size") * (key % 11)).cast("int"))).alias("until"),
                         F.when(key % 70 == 0, F.lit(-1e300)).otherwise(amount).alias("least"), (amount + 400.0 * c("p_size") * (key % 5)).alias("most"))


@query("theta_condition_two_ports", f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders)
SELECT o.o_orderkey, o.day, o.o_totalprice, arg_max(b.brand, b.id) AS brand, max(b.id) AS offer FROM o LEFT JOIN {_OFFERS} b
  ON o.day BETWEEN b.since AND b.until AND o.o_totalprice >= b.least AND o.o_totalprice < b.most GROUP BY 1, 2, 3""")
def theta_condition_two_ports(t):
    """A validity in days and a range of amounts in one condition."""
    orders = t.orders.select("o_orderkey", c("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return L.lookup_where(orders, _offers(t), [("day", ">=", "since"), ("day", "<=", "until"), ("o_totalprice", ">=", "least"), ("o_totalprice", "<", "most")],
                          {"brand": "brand", "offer": "id"}, "Last", ["id"])


# Orders whose status is NULL for some, on both sides.
_STATUS = "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END"
_UNLIKE = f"""SELECT a.o_orderkey, a.st, {{pick}} AS other FROM (SELECT o_orderkey, o_custkey, {_STATUS} AS st FROM orders) a
LEFT JOIN (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, {_STATUS} AS st FROM orders) b ON a.o_custkey = b.c AND a.st <> b.st GROUP BY 1, 2"""


def _unlike(t, policy):
    status = F.when(c("o_orderkey") % 13 == 0, None).otherwise(c("o_orderstatus"))
    mine = t.orders.select("o_orderkey", "o_custkey", status.alias("st"))
    table = t.orders.select(c("o_orderkey").alias("k"), c("o_custkey").alias("c"), c("o_orderdate").alias("d"), status.alias("tst"))
    return L.lookup_where(mine, table, [("o_custkey", "=", "c"), ("st", "<>", "tst")], {"other": "k"}, policy, ["d", "k"]).drop("o_custkey")


@query("unlike_first", _UNLIKE.format(pick="arg_min(b.k, (b.d, b.k))"))
def unlike_first(t):
    """Another order of the customer with another status: an equality and a ``<>``."""
    return _unlike(t, "First")


@query("unlike_last", _UNLIKE.format(pick="arg_max(b.k, (b.d, b.k))"))
def unlike_last(t):
    return _unlike(t, "Last")


@query("unlike_any", _UNLIKE.format(pick="min(b.k)"))
def unlike_any(t):
    return _unlike(t, "Any")


@query("theta_condition_unlike", f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'Brand#' || (o_orderkey % 5 + 1) || (o_custkey % 5 + 1) AS mine FROM orders)
SELECT o.o_orderkey, o.mine, arg_min(b.brand, b.id) AS brand, min(b.id) AS offer FROM o LEFT JOIN {_OFFERS} b ON o.day BETWEEN b.since AND b.until AND o.mine <> b.brand GROUP BY 1, 2""")
def theta_condition_unlike(t):
    """A range and a ``<>``: the offer of the day by another brand."""
    orders = t.orders.select("o_orderkey", c("o_orderdate").cast("date").alias("day"),
                             F.concat(F.lit("Brand#"), (c("o_orderkey") % 5 + 1).cast("string"), (c("o_custkey") % 5 + 1).cast("string")).alias("mine"))
    out = L.lookup_where(orders, _offers(t), [("day", ">=", "since"), ("day", "<=", "until"), ("mine", "<>", "brand")], {"brand": "brand", "offer": "id"}, "First", ["id"])
    return out.select("o_orderkey", "mine", "brand", "offer")


@query("insert_only_new", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def insert_only_new(t):
    return L.only_new(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_mktsegment = 'MACHINERY'"), [("o_custkey", "c_custkey")])
