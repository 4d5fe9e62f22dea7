"""One query a scalar function, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import DIRTY, STAMPS
from weftwork.functions import dates as D
from weftwork.functions import scalar as S

c = F.col
VIEWS = {"dirty": DIRTY, "stamps": STAMPS}


def fn(name: str, source: str, key: str, outputs: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """Register ``key`` plus output columns, each given as (Column builder, checking SQL), over a table or view."""
    table = f"({duck(VIEWS[source])}) v" if source in VIEWS else source
    sql = f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, (_, s) in outputs.items()) + f" FROM {table}"

    @query(name, sql)
    def run(t):
        df = t.sql(VIEWS[source]) if source in VIEWS else getattr(t, source)
        return df.select(key, *[col().alias(n) for n, (col, _) in outputs.items()])


DEC = "decimal(38,9)"

fn("fn_to_date", "dirty", "o_orderkey", {
    "iso": (lambda: S.to_date(c("date_s"), "YYYY-MM-DD"), "try_strptime(trim(date_s), '%Y-%m-%d')"),
    "compact": (lambda: S.to_date(c("ymd"), "YYYYMMDD"), "try_strptime(ymd, '%Y%m%d')")})
fn("fn_to_char", "stamps", "event_id", {
    "day": (lambda: S.to_char(c("ts"), "YYYY-MM-DD HH24:MI:SS"), "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "num": (lambda: S.to_char(c("user_id")), "CAST(user_id AS VARCHAR)")})
fn("fn_lpad", "customer", "c_custkey", {"out": (lambda: S.lpad(c("c_mktsegment"), 9, "*"), "lpad(c_mktsegment, 9, '*')"),
                                        "dflt": (lambda: S.lpad(c("c_mktsegment"), 12), "lpad(c_mktsegment, 12, ' ')")})
fn("fn_rpad", "customer", "c_custkey", {"out": (lambda: S.rpad(c("c_mktsegment"), 9, "*"), "rpad(c_mktsegment, 9, '*')")})
fn("fn_substr", "part", "p_partkey", {"mid": (lambda: S.substr(c("p_name"), 3, 4), "substr(p_name, 3, 4)"),
                                      "tail": (lambda: S.substr(c("p_name"), -4), "right(p_name, 4)"),
                                      "zero": (lambda: S.substr(c("p_name"), 0, 2), "left(p_name, 2)")})
fn("fn_replacechr", "part", "p_partkey", {
    "exact": (lambda: S.replace_chr(True, c("p_type"), "OE", "0"), "translate(p_type, 'OE', '00')"),
    "any_case": (lambda: S.replace_chr(False, c("p_name"), "AE", "_-"), "regexp_replace(p_name, '[aeAE]', '_-', 'g')"),
    "dropped": (lambda: S.replace_chr(True, c("p_name"), " ", ""), "replace(p_name, ' ', '')")})
fn("fn_to_decimal", "dirty", "o_orderkey", {
    "d9": (lambda: S.to_decimal(c("num_s")), "TRY_CAST(trim(num_s) AS DECIMAL(38,9))"),
    "d1": (lambda: S.to_decimal(c("num_s"), 1), "TRY_CAST(trim(num_s) AS DECIMAL(38,1))")})
fn("fn_replacestr", "part", "p_partkey", {
    "exact": (lambda: S.replace_str(True, c("p_name"), ["red", "ring"], "$1"), "replace(replace(p_name, 'red', '$1'), 'ring', '$1')"),
    "any_case": (lambda: S.replace_str(False, c("p_name"), ["BLUE"], "b"), "regexp_replace(p_name, 'blue', 'b', 'gi')")})
fn("fn_concat", "dirty", "o_orderkey", {
    "out": (lambda: S.concat(c("num_s"), c("date_s")),
            "CASE WHEN num_s IS NULL AND date_s IS NULL THEN NULL ELSE concat(num_s, date_s) END")})
fn("fn_trunc", "stamps", "event_id", {
    "day": (lambda: S.trunc_date(c("ts")), "date_trunc('day', ts)"), "month": (lambda: S.trunc_date(c("ts"), "MM"), "date_trunc('month', ts)"),
    "hour": (lambda: S.trunc_date(c("ts"), "HH24"), "date_trunc('hour', ts)"),
    "cut": (lambda: S.trunc_number((c("value") - 250).cast(DEC), 1).cast("double"), "trunc((value - 250)::DECIMAL(38,9) * 10) / 10"),
    "tens": (lambda: S.trunc_number((c("value") - 250).cast(DEC), -1).cast("double"), "trunc((value - 250)::DECIMAL(38,9) / 10) * 10")})
fn("fn_to_integer", "dirty", "o_orderkey", {
    "out": (lambda: S.to_integer(c("num_s")), "CAST(trunc(TRY_CAST(trim(num_s) AS DECIMAL(38,9))) AS INTEGER)")})
fn("fn_length", "documents", "doc_id", {"out": (lambda: S.length(c("text")), "length(text)")})
fn("fn_upper", "part", "p_partkey", {"out": (lambda: S.upper(c("p_name")), "upper(p_name)")})
fn("fn_isnull", "dirty", "o_orderkey", {"out": (lambda: S.isnull(c("num_s")), "num_s IS NULL")})
fn("fn_is_number", "dirty", "o_orderkey", {"out": (lambda: S.is_number(c("num_s")), "TRY_CAST(trim(num_s) AS DOUBLE) IS NOT NULL OR "
                                                   "CASE WHEN num_s IS NULL THEN NULL ELSE FALSE END")})
fn("fn_instr", "part", "p_partkey", {
    "first": (lambda: S.instr(c("p_name"), "e"), "instr(p_name, 'e')"),
    "later": (lambda: S.instr(c("p_name"), "e", 3),
              "CASE WHEN instr(substr(p_name, 3), 'e') > 0 THEN instr(substr(p_name, 3), 'e') + 2 ELSE 0 END"),
    "second": (lambda: S.instr(c("p_name"), "e", 1, 2),
               "CASE WHEN len(string_split(p_name, 'e')) < 3 THEN 0 ELSE length(string_split(p_name, 'e')[1]) + "
               "length(string_split(p_name, 'e')[2]) + 2 END")})
fn("fn_in", "orders", "o_orderkey", {"out": (lambda: S.in_(c("o_orderpriority"), "1-URGENT", "2-HIGH"), "o_orderpriority IN ('1-URGENT', '2-HIGH')")})
fn("fn_iif", "dirty", "o_orderkey", {
    "both": (lambda: S.iif(c("num_s") > "5", F.lit("hi"), F.lit("lo")), "CASE WHEN num_s > '5' THEN 'hi' ELSE 'lo' END"),
    "single": (lambda: S.iif(c("o_orderstatus") == "O", c("amt")), "CASE WHEN o_orderstatus = 'O' THEN amt END")})
fn("fn_greatest", "lineitem", "l_orderkey", {"out": (lambda: S.greatest(c("l_quantity"), c("l_discount") * 100, c("l_tax") * 500),
                                                     "greatest(l_quantity, l_discount * 100, l_tax * 500)")})
fn("fn_is_spaces", "dirty", "o_orderkey", {"out": (lambda: S.is_spaces(c("date_s")), "length(date_s) > 0 AND trim(date_s) = ''")})
fn("fn_decode", "dirty", "o_orderkey", {
    "out": (lambda: S.decode(c("o_orderstatus"), "O", 1, "F", 2, 9), "CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 9 END"),
    "nulls": (lambda: S.decode(c("num_s"), None, "none", "", "blank", "other"),
              "CASE WHEN num_s IS NULL THEN 'none' WHEN num_s = '' THEN 'blank' ELSE 'other' END")})
fn("fn_abs", "customer", "c_custkey", {"out": (lambda: S.abs_(c("c_acctbal") - 3000), "abs(c_acctbal - 3000)")})
fn("fn_add_to_date", "stamps", "event_id", {
    "month": (lambda: S.add_to_date(c("ts"), "MM", -1), "ts - INTERVAL 1 MONTH"),
    "days": (lambda: S.add_to_date(c("ts"), "DD", 40), "ts + INTERVAL 40 DAY"),
    "hours": (lambda: S.add_to_date(c("ts"), "HH24", c("user_id")), "ts + user_id * INTERVAL 1 HOUR"),
    "year": (lambda: S.add_to_date(c("ts"), "YYYY", 1), "ts + INTERVAL 1 YEAR"),
    "secs": (lambda: S.add_to_date(c("ts"), "SS", -90), "ts - INTERVAL 90 SECOND")})
fn("fn_last_day", "orders", "o_orderkey", {"out": (lambda: S.last_day(c("o_orderdate")), "CAST(last_day(o_orderdate) AS TIMESTAMP)")})
fn("fn_date_diff", "stamps", "event_id", {
    "days": (lambda: F.round(S.date_diff(c("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), "DD"), 6),
             "round(epoch_us(ts) / 86400e6 - epoch_us(TIMESTAMP '2024-01-10') / 86400e6, 6)"),
    "hours": (lambda: F.round(S.date_diff(c("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), "HH"), 5),
              "round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10')) / 3600e6, 5)")})
fn("fn_get_date_part", "stamps", "event_id", {
    "y": (lambda: S.get_date_part(c("ts"), "YYYY"), "year(ts)"), "m": (lambda: S.get_date_part(c("ts"), "MM"), "month(ts)"),
    "d": (lambda: S.get_date_part(c("ts"), "DD"), "day(ts)"), "h": (lambda: S.get_date_part(c("ts"), "HH24"), "hour(ts)"),
    "mi": (lambda: S.get_date_part(c("ts"), "MI"), "minute(ts)"), "s": (lambda: S.get_date_part(c("ts"), "SS"), "CAST(floor(second(ts)) AS INT)")})
fn("fn_is_date", "dirty", "o_orderkey", {
    "out": (lambda: S.is_date(c("date_s"), "YYYY-MM-DD"), "try_strptime(trim(date_s), '%Y-%m-%d') IS NOT NULL")})
fn("fn_chr", "part", "p_partkey", {"out": (lambda: S.chr_(c("p_size") + 64), "chr(p_size + 64)")})
fn("fn_reg_match", "part", "p_partkey", {"whole": (lambda: S.reg_match(c("p_brand"), r"Brand#\d"), r"regexp_full_match(p_brand, 'Brand#\d')"),
                                         "part": (lambda: S.reg_match(c("p_brand"), "1", anchored=False), "contains(p_brand, '1')")})
fn("fn_least", "lineitem", "l_orderkey", {"out": (lambda: S.least(c("l_quantity"), c("l_discount") * 100, c("l_tax") * 500),
                                                  "least(l_quantity, l_discount * 100, l_tax * 500)")})
fn("fn_reg_replace", "part", "p_partkey", {"out": (lambda: S.reg_replace(c("p_brand"), "[0-9]+", "N"), "regexp_replace(p_brand, '[0-9]+', 'N', 'g')")})
fn("fn_trim", "dirty", "o_orderkey", {"both": (lambda: S.trim(c("num_s")), "trim(num_s)"), "l": (lambda: S.ltrim(c("num_s")), "ltrim(num_s)"),
                                      "r": (lambda: S.rtrim(c("num_s")), "rtrim(num_s)")})
fn("fn_sysdate", "orders", "o_orderkey", {
    "later": (lambda: c("o_orderdate") < S.sysdate("2000-01-01 00:00:00"), "o_orderdate < TIMESTAMP '2000-01-01 00:00:00'"),
    "past": (lambda: c("o_orderdate") < S.sysdate().cast("timestamp_ntz"), "o_orderdate < now()::TIMESTAMP")})
fn("fn_not", "dirty", "o_orderkey", {"out": (lambda: S.not_(c("num_s") > "5"), "NOT (num_s > '5')")})
fn("fn_arithmetic", "lineitem", "l_orderkey", {
    "a": (lambda: S.arithmetic(c("l_quantity"), "+", c("l_tax")), "l_quantity + l_tax"),
    "s": (lambda: S.arithmetic(c("l_quantity"), "-", c("l_tax")), "l_quantity - l_tax"),
    "m": (lambda: S.arithmetic(c("l_quantity"), "*", c("l_discount")), "l_quantity * l_discount"),
    "d": (lambda: F.round(S.arithmetic(c("l_quantity"), "/", c("l_discount")), 6), "round(l_quantity / nullif(l_discount, 0), 6)")})
fn("fn_comparison", "lineitem", "l_orderkey", {
    n: (lambda op=op: S.comparison(c("l_partkey"), op, c("l_suppkey") * 20), f"l_partkey {'<>' if op == '^=' else op} l_suppkey * 20")
    for n, op in {"le": "<=", "ge": ">=", "ne": "<>", "ne2": "!=", "ne3": "^=", "eq": "=", "gt": ">", "lt": "<"}.items()})
fn("fn_logical", "dirty", "o_orderkey", {
    "both": (lambda: S.logical(c("num_s") > "5", " AND ", c("o_orderstatus") == "O"), "num_s > '5' AND o_orderstatus = 'O'"),
    "either": (lambda: S.logical(c("num_s") > "5", " or ", c("o_orderstatus") == "O"), "num_s > '5' OR o_orderstatus = 'O'")})
fn("fn_lower", "customer", "c_custkey", {"out": (lambda: S.lower(c("c_mktsegment")), "lower(c_mktsegment)")})
fn("fn_round", "orders", "o_orderkey", {"out": (lambda: S.round_(c("o_totalprice").cast("decimal(18,2)"), 1), "round(o_totalprice::DECIMAL(18,2), 1)"),
                                        "k": (lambda: S.round_(c("o_totalprice").cast("decimal(18,2)"), -3), "round(o_totalprice::DECIMAL(18,2), -3)")})
fn("fn_nvl", "dirty", "o_orderkey", {"out": (lambda: S.nvl(c("num_s"), "none"), "coalesce(num_s, 'none')")})
fn("fn_regexp_like", "part", "p_partkey", {"out": (lambda: S.regexp_like(c("p_name"), "r.*n"), "regexp_matches(p_name, 'r.*n')")})
fn("fn_to_number", "dirty", "o_orderkey", {"out": (lambda: S.to_number(c("num_s")), "TRY_CAST(num_s AS DECIMAL(38,9))")})
fn("fn_latin_to_ascii", "documents", "doc_id", {"out": (lambda: F.md5(S.latin_to_ascii(c("text"))), "md5(strip_accents(text))")})
fn("fn_parse_date_multi", "dirty", "o_orderkey", {
    "out": (lambda: D.parse_date_multi(c("date_s")),
            "CAST(try_strptime(trim(date_s), ['%Y-%m-%d', '%Y%m%d', '%d/%m/%Y', '%Y.%m.%d', '%d.%m.%Y', '%d-%m-%Y']) AS DATE)")})
fn("fn_parse_timestamp_multi", "stamps", "event_id", {
    "out": (lambda: D.parse_timestamp_multi(c("ts_s")),
            "try_strptime(trim(ts_s), ['%Y-%m-%d-%H.%M.%S', '%Y-%m-%d-%H:%M:%S', '%Y%m%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S'])")})
fn("fn_parse_year_month", "dirty", "o_orderkey", {
    "out": (lambda: D.parse_year_month(c("month_s")), "CASE WHEN regexp_full_match(month_s, '[0-9]{6}') THEN "
            "make_date(CAST(left(month_s, 4) AS BIGINT), CAST(right(month_s, 2) AS BIGINT), 1) END")})
fn("fn_parse_time_multi", "stamps", "event_id", {
    "out": (lambda: D.parse_time_multi(c("time_s")), r"CASE WHEN regexp_full_match(time_s, '\d\d[.]\d\d[.]\d\d|\d\d:\d\d:\d\d') THEN "
            "CAST(left(time_s, 2) AS INT) * 3600 + CAST(substr(time_s, 4, 2) AS INT) * 60 + CAST(right(time_s, 2) AS INT) END")})
fn("fn_null_date_sentinels", "dirty", "o_orderkey", {
    "out": (lambda: D.null_date_sentinels(c("date_s")),
            "CASE WHEN trim(date_s) IN ('00000000', '0000000000', '0', '00.00.0000', '99991231') THEN NULL ELSE date_s END")})
fn("fn_timestamp_border_cases", "stamps", "event_id", {
    "out": (lambda: D.timestamp_border_cases(c("border_s").cast("timestamp_ntz")),
            "CASE WHEN year(border_s::TIMESTAMP) = 1 THEN NULL ELSE border_s::TIMESTAMP END")})
fn("fn_parse_duration", "stamps", "event_id", {
    "minutes": (lambda: F.round(D.parse_duration(c("dur")), 6),
                r"CASE WHEN regexp_full_match(dur, '(\d+)m (\d+)sec') THEN round(CAST(split_part(dur, 'm', 1) AS INT) + "
                r"CAST(replace(split_part(dur, ' ', 2), 'sec', '') AS INT) / 60.0, 6) END"),
    "seconds": (lambda: D.duration_seconds(c("dur")),
                r"CASE WHEN regexp_full_match(dur, '(\d+)m (\d+)sec') THEN CAST(split_part(dur, 'm', 1) AS INT) * 60 + "
                r"CAST(replace(split_part(dur, ' ', 2), 'sec', '') AS INT) END")})
