"""Queries for data-quality validations over dirty text forms of the orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import DIRTY, STAMPS
from weftwork.functions import validate as V

c = F.col
_D = f"({duck(DIRTY)}) d"
_S = f"({duck(STAMPS)}) s"
_NUM = "TRY_CAST(trim(num_s) AS DECIMAL(38,9))"
_BLANK = "coalesce(trim({0}), '') = ''"
_DATE = "CAST(try_strptime(trim(date_s), ['%Y-%m-%d', '%Y%m%d', '%d/%m/%Y', '%Y.%m.%d', '%d.%m.%Y', '%d-%m-%Y']) AS DATE)"
_TS = "try_strptime(trim(ts_s), ['%Y-%m-%d-%H.%M.%S', '%Y-%m-%d-%H:%M:%S', '%Y%m%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S'])"


def _sql(key: str, source: str, raw: str, value: str, code: str, not_null: bool = False, default: str = "NULL") -> str:
    """Checking SQL: value and error of one validation."""
    empty = _BLANK.format(raw)
    missing = f"'ERROR_NULL|' || coalesce({raw}, '')" if not_null else "NULL"
    return (f"SELECT {key}, CASE WHEN {empty} THEN {default} ELSE {value} END AS val, "
            f"CASE WHEN {empty} THEN {missing} WHEN {value} IS NULL THEN '{code}|' || {raw} END AS error FROM {source}")


def _out(df, key, checked):
    return df.select(key, checked.alias("v")).select(key, c("v.value").alias("val"), c("v.error").alias("error"))


@query("validate_num", _sql("o_orderkey", _D, "num_s", _NUM, "ERROR_NUMBER"))
def validate_num(t):
    return _out(t.sql(DIRTY), "o_orderkey", V.validate_num(c("num_s")))


@query("validate_num_not_null", _sql("o_orderkey", _D, "num_s", _NUM, "ERROR_NUMBER", True))
def validate_num_not_null(t):
    return _out(t.sql(DIRTY), "o_orderkey", V.validate_num(c("num_s"), not_null=True))


@query("validate_not_null", _sql("o_orderkey", _D, "date_s", "date_s", "ERROR_NULL", True))
def validate_not_null(t):
    return _out(t.sql(DIRTY), "o_orderkey", V.validate_not_null(c("date_s")))


@query("validate_not_null_default", _sql("o_orderkey", _D, "date_s", "date_s", "ERROR_NULL", False, "'n/a'"))
def validate_not_null_default(t):
    return _out(t.sql(DIRTY), "o_orderkey", V.validate_not_null(c("date_s"), default="n/a"))


@query("validate_date", f"""
SELECT a.o_orderkey, a.val AS plain, a.error AS plain_error, b.val AS strict, b.error AS strict_error, d.val AS filled, d.error AS filled_error
FROM ({_sql('o_orderkey', _D, 'date_s', _DATE, 'ERROR_DATE')}) a JOIN ({_sql('o_orderkey', _D, 'date_s', _DATE, 'ERROR_DATE', True)}) b USING (o_orderkey)
JOIN ({_sql('o_orderkey', _D, 'date_s', _DATE, 'ERROR_DATE', False, "DATE '1900-01-01'")}) d USING (o_orderkey)""")
def validate_date(t):
    kinds = {"plain": {}, "strict": {"not_null": True}, "filled": {"default": True}}
    out = t.sql(DIRTY).select("o_orderkey", *[V.validate_date(c("date_s"), **k).alias(n) for n, k in kinds.items()])
    return out.select("o_orderkey", *[x for n in kinds for x in (c(f"{n}.value").alias(n), c(f"{n}.error").alias(f"{n}_error"))])


@query("validate_timestamp", _sql("event_id", _S, "ts_s", _TS, "ERROR_TIMESTAMP", True))
def validate_timestamp(t):
    return _out(t.sql(STAMPS), "event_id", V.validate_timestamp(c("ts_s"), not_null=True))


@query("validate_decimal", _sql("o_orderkey", _D, "num_s", "TRY_CAST(trim(num_s) AS DECIMAL(7,2))", "ERROR_DECIMAL"))
def validate_decimal(t):
    return _out(t.sql(DIRTY), "o_orderkey", V.validate_decimal(c("num_s"), 7, 2))


_ERRORS = f"""
SELECT o_orderkey, 'num_s' AS field, split_part(error, '|', 1) AS code, substr(error, instr(error, '|') + 1) AS raw
FROM ({_sql('o_orderkey', _D, 'num_s', _NUM, 'ERROR_NUMBER', True)}) WHERE error IS NOT NULL
UNION ALL SELECT o_orderkey, 'date_s', split_part(error, '|', 1), substr(error, instr(error, '|') + 1)
FROM ({_sql('o_orderkey', _D, 'date_s', _DATE, 'ERROR_DATE')}) WHERE error IS NOT NULL"""


def _validated(t):
    return V.validate(t.sql(DIRTY).select("o_orderkey", "num_s", "date_s"),
                      {"num_s": V.num(c("num_s"), not_null=True), "date_s": V.date(c("date_s"))})


@query("validate_row", f"""
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'Y' ELSE 'N' END AS LOAD_DATA, coalesce(n, 0) AS n_errors
FROM orders LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM ({_ERRORS}) GROUP BY 1) e USING (o_orderkey)""")
def validate_row(t):
    return _validated(t).select("o_orderkey", "LOAD_DATA", F.size("errors").alias("n_errors"))


@query("split_good_bad", f"""
SELECT o_orderkey, field, code, raw FROM ({_ERRORS})
UNION ALL SELECT o_orderkey, 'row', 'OK', '' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_ERRORS}))""")
def split_good_bad(t):
    good, bad = V.split(_validated(t), ["o_orderkey"])
    return bad.unionByName(good.select("o_orderkey", F.lit("row").alias("field"), F.lit("OK").alias("code"), F.lit("").alias("raw")))


def _rule(name: str, cond: str, table: str) -> str:
    return (f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {cond}) AS passed, count(*) FILTER (WHERE NOT ({cond})) AS failed, "
            f"count(*) FILTER (WHERE ({cond}) IS NULL) AS unknown FROM {table}")


@query("quality_flag", " UNION ALL ".join([_rule("amount_numeric", f"{_NUM} IS NOT NULL", _D), _rule("positive", f"{_NUM} > 0", _D),
                                            _rule("dated", f"NOT ({_BLANK.format('date_s')})", _D)]))
def quality_flag(t):
    num = F.trim(c("num_s")).try_cast("decimal(38,9)")
    return V.quality_checks(t.sql(DIRTY), {"amount_numeric": num.isNotNull(), "positive": num > 0, "dated": ~V.blank(c("date_s"))})
