"""Queries for projection, filters, row reshaping, unions, keys and user code."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import DIRTY
from weftwork.functions import scalar as S
from weftwork.operators import rows as R
from weftwork.operators import sets
from weftwork.operators.keys import sequence
from weftwork.operators.lookups import lookup
from weftwork.operators.udf import procedure, row_code

c = F.col


@query("segment_revenue", """
SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1""")
def segment_revenue(t):
    """Flagship: orders enriched through a customer lookup, filtered, summed per segment."""
    from weftwork.operators.aggregates import aggregate

    orders = R.keep_true(t.orders, c("o_orderstatus") != "P")
    slim = R.project(orders, [R.Field("custkey", c("o_custkey"), "bigint"), R.Field("price", c("o_totalprice"), "double")])
    named = lookup(slim, t.customer, [("custkey", "c_custkey")], {"segment": "c_mktsegment"}, "First", ["c_name"])
    return aggregate(named, ["segment"], {"n_orders": F.count("*"), "revenue": F.round(F.sum("price"), 2)})


@query("project", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state FROM orders""")
def project(t):
    return R.project(t.orders, [R.Field("order_id", c("o_orderkey"), "string"),
                                R.Field("amount", F.round(c("o_totalprice"), 2), "decimal(18,2)"),
                                R.Field("state", S.iif(c("o_orderstatus") == "O", "open", "closed"), "string")])


@query("null_column", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS unlinked FROM orders")
def null_column(t):
    return R.project(t.orders, [R.Field("o_orderkey", c("o_orderkey")), R.Field("unlinked", None, "string")])


@query("local_variables", """
SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2)) AS charge
FROM lineitem""")
def local_variables(t):
    money = lambda name, type_: c(name).cast(type_)
    out = R.with_variables(t.lineitem, [("v_net", money("l_extendedprice", "decimal(12,2)") * (1 - money("l_discount", "decimal(4,2)"))),
                                        ("v_rate", 1 + money("l_tax", "decimal(4,2)")), ("charge", c("v_net") * c("v_rate"))], ["charge"])
    return out.select("l_orderkey", "l_linenumber", "charge")


@query("filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE nullif(l_returnflag, 'N') = 'A' AND l_quantity > 30")
def keep(t):
    cond = (F.nullif(c("l_returnflag"), F.lit("N")) == "A") & (c("l_quantity") > 30)
    return R.keep_true(t.lineitem, cond).select("l_orderkey", "l_linenumber", "l_quantity")


@query("source_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus IN ('F', 'P')")
def source_filter(t):
    out = R.source_filter(t.orders, "ORDERS.o_orderdate >= timestamp_ntz'1998-01-01' AND ORDERS.o_orderstatus IN ('F', 'P')", "ORDERS")
    return out.select("o_orderkey", "o_totalprice")


@query("select_distinct", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def select_distinct(t):
    return R.select_distinct(t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag"))


def price_groups():
    return {"BIG": c("o_totalprice") > 300000, "URGENT": F.nullif(c("o_orderpriority"), F.lit("3-MEDIUM")) <= "2-HIGH",
            "OPEN": c("o_orderstatus") == "O"}


_ROUTES = """
SELECT 'BIG' AS g, o_orderkey FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'URGENT', o_orderkey FROM orders WHERE o_orderpriority <> '3-MEDIUM' AND o_orderpriority <= '2-HIGH'
UNION ALL SELECT 'OPEN', o_orderkey FROM orders WHERE o_orderstatus = 'O'"""


@query("router", _ROUTES)
def router(t):
    return R.tag_groups(t.orders, price_groups(), name="g").select("g", "o_orderkey")


@query("router_default", _ROUTES + """
UNION ALL SELECT 'DEFAULT1', o_orderkey FROM orders WHERE NOT (o_totalprice > 300000)
  AND NOT (o_orderpriority IN ('1-URGENT', '2-HIGH')) AND o_orderstatus <> 'O'""")
def router_default(t):
    parts = R.route(t.orders, price_groups(), default="DEFAULT1")
    return sets.fan_in([df.select(F.lit(g).alias("g"), "o_orderkey") for g, df in parts.items()])


def _repeated(t):
    v2 = F.nullif(c("l_tax"), F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", c("l_quantity").alias("v1"), v2.alias("v2"), c("l_discount").alias("v3"),
                             c("l_partkey").alias("k1"), c("l_suppkey").alias("k2"), c("l_orderkey").alias("k3"))


_VALUES = "(VALUES (1), (2), (3)) i(n)"
_PICK = "CASE n WHEN 1 THEN l_quantity WHEN 2 THEN nullif(l_tax, 0) ELSE l_discount END"


@query("normalizer", f"""
SELECT l_orderkey, l_linenumber, {_PICK} AS val, CASE n WHEN 1 THEN l_partkey WHEN 2 THEN l_suppkey ELSE l_orderkey END AS k
FROM lineitem, {_VALUES}""")
def normalizer(t):
    return R.normalize(_repeated(t), {"l_orderkey": ["l_orderkey"], "l_linenumber": ["l_linenumber"],
                                      "val": ["v1", "v2", "v3"], "k": ["k1", "k2", "k3"]})


@query("generated_column_id", f"SELECT l_orderkey, l_linenumber, {_PICK} AS val, n AS GCID_val FROM lineitem, {_VALUES}")
def generated_column_id(t):
    return R.normalize(_repeated(t), {"l_orderkey": ["l_orderkey"], "l_linenumber": ["l_linenumber"], "val": ["v1", "v2", "v3"]}, gcid=True)


@query("generated_key", """
SELECT o_orderkey, o_orderpriority AS word, 1 AS GCID_word, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS GK_word FROM orders
UNION ALL SELECT o_orderkey, o_orderstatus, 2, row_number() OVER (ORDER BY o_orderdate, o_orderkey) FROM orders""")
def generated_key(t):
    return R.normalize(t.orders, {"o_orderkey": ["o_orderkey"], "word": ["o_orderpriority", "o_orderstatus"]},
                       gcid=True, gk=True, order_by=["o_orderdate", "o_orderkey"])


@query("sequence_generator", "SELECT event_id, 95 + 5 * row_number() OVER (ORDER BY value DESC, event_id) AS NEXTVAL FROM events")
def sequence_generator(t):
    return sequence(t.events.select("event_id", "value"), [c("value").desc(), c("event_id")], start=100, step=5).select("event_id", "NEXTVAL")


@query("mapplet", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'H' ELSE 'L' END || lower(o_orderstatus) AS band FROM orders""")
def mapplet(t):
    def steps(df):
        level = S.iif(c("in_amount") >= 250000, "H", "L")
        return df.withColumn("out_code", S.concat(level, S.lower(c("in_code"))))

    return R.mapplet(t.orders, steps, {"in_amount": "o_totalprice", "in_code": "o_orderstatus"}, {"band": "out_code"}).select("o_orderkey", "band")


@query("global_transformation", "SELECT c_custkey, upper(left(c_mktsegment, 3)) || '-' || CAST(c_nationkey AS VARCHAR) AS code FROM customer")
def global_transformation(t):
    R.register_global("SEGMENT_CODE", lambda seg, nat: S.concat(S.concat(S.upper(S.substr(seg, 1, 3)), F.lit("-")), nat))
    return t.customer.select("c_custkey", R.apply_global("SEGMENT_CODE", c("c_mktsegment"), c("c_nationkey")).alias("code"))


@query("mapping_parameter", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def mapping_parameter(t):
    return R.parametrised_sql(t.spark, "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus = $$STATUS AND o_totalprice > $$FLOOR",
                              {"STATUS": "F", "FLOOR": 100000.0}, orders=t.orders)


@query("union_mapped", """
SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance, c_mktsegment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_mapped(t):
    return sets.union_groups(
        {"CUST": t.customer.drop("c_nationkey"), "SUPP": t.supplier.drop("s_nationkey")},
        {"CUST": {"c_custkey": "id", "c_name": "label", "c_acctbal": "balance"},
         "SUPP": {"s_suppkey": "id", "s_name": "label", "s_acctbal": "balance"}})


@query("fan_in_append", """
SELECT o_orderkey AS k, 'order' AS src FROM orders UNION ALL SELECT l_orderkey, 'line' FROM lineitem UNION ALL SELECT event_id, 'event' FROM events""")
def fan_in_append(t):
    part = lambda df, k, s: df.select(c(k).alias("k"), F.lit(s).alias("src"))
    return sets.fan_in([part(t.orders, "o_orderkey", "order"), part(t.lineitem, "l_orderkey", "line"), part(t.events, "event_id", "event")])


@query("row_code", f"""
SELECT o_orderkey, i AS copy, num_s AS txt FROM ({duck(DIRTY)}) d, generate_series(1, 2) g(i)
WHERE num_s IS NOT NULL AND num_s <> '' AND (i = 1 OR num_s LIKE 'x%')""")
def user_rows(t):
    """User code that drops blank rows and doubles junk ones."""
    def code(row):
        if row["num_s"]:
            yield {"o_orderkey": row["o_orderkey"], "copy": 1, "txt": row["num_s"]}
            if row["num_s"].startswith("x"):
                yield {"o_orderkey": row["o_orderkey"], "copy": 2, "txt": row["num_s"]}

    return row_code(t.sql(DIRTY), code, "o_orderkey bigint, copy int, txt string", ["o_orderkey", "num_s"])


_BIG = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey + 9007199254740993 END"


@query("row_code_exact", f"SELECT {_BIG} AS big, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount, o_orderkey % 7 = 0 AS missing FROM orders")
def exact_rows(t):
    """User code sees NULL as None and integers beyond 2^53 as they are."""
    def code(row):
        out = {"big": row["big"], "missing": row["big"] is None}
        yield out if row["amount"] is None else out | {"amount": row["amount"]}

    given = t.orders.select(F.expr(_BIG).alias("big"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("amount"))
    return row_code(given, code, "big bigint, amount double, missing boolean")


@query("procedure_value", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice / 100, 4) AS RESULT FROM lineitem")
def procedure_value(t):
    out = procedure(t.lineitem, lambda q, p: F.round(q * p / 100, 4), ["l_quantity", "l_extendedprice"], "RESULT")
    return out.select("l_orderkey", "l_linenumber", "RESULT")
