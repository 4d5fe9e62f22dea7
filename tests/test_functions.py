"""Edge cases of scalar functions, date parsing and validations."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftwork.functions import dates as D
from weftwork.functions import scalar as S
from weftwork.functions import validate as V


def value(spark, make, text, type_="string"):
    return spark.createDataFrame([(text,)], f"x {type_}").select(make(F.col("x")).alias("v")).first()["v"]


@pytest.mark.parametrize("make, text, want", [
    (lambda x: S.to_integer(x), " -3.9 ", -3), (lambda x: S.to_integer(x), "x", None), (lambda x: S.to_integer(x), "99999999999", None),
    (lambda x: S.to_decimal(x, 2), "1.239", Decimal("1.24")), (lambda x: S.is_number(x), "1e5", True), (lambda x: S.is_number(x), "1e", False),
    (lambda x: S.is_number(x), "", False), (lambda x: S.substr(x, -2), "abcd", "cd"), (lambda x: S.substr(x, 0, 2), "abcd", "ab"),
    (lambda x: S.replace_chr(False, x, "aB", ""), "AbCaB", "C"), (lambda x: S.replace_chr(True, x, "$.", "\\"), "a$.b", "a\\\\b"),
    (lambda x: S.replace_str(False, x, ["ab", "c"], "$0"), "xABcx", "x$0$0x"), (lambda x: S.instr(x, "a", 1, 3), "banana", 6),
    (lambda x: S.instr(x, "a", 1, 4), "banana", 0), (lambda x: S.concat(x, F.lit(None)), "a", "a"), (lambda x: S.concat(x, F.lit(None)), None, None),
    (lambda x: S.is_spaces(x), "  ", True), (lambda x: S.is_spaces(x), "", False), (lambda x: S.iif(F.lit(None).cast("boolean"), 1, 2), "", 2),
    (lambda x: S.decode(x, None, "n", "a", "A", "z"), None, "n"), (lambda x: S.decode(x, "a", "A"), "b", None),
    (lambda x: S.latin_to_ascii(x), "Ñandú éçà", "Nandu eca"), (lambda x: S.reg_match(x, "a|b"), "ab", False),
    (lambda x: S.nvl(x, "d"), None, "d"), (lambda x: S.arithmetic(F.lit(1.0), "/", F.lit(0.0)), "", None)])
def test_text_functions(spark, make, text, want):
    assert value(spark, make, text) == want


def test_last_day_and_month_steps(spark):
    at = lambda make: value(spark, make, datetime(2024, 1, 31, 10, 30), "timestamp_ntz")
    assert at(S.last_day) == datetime(2024, 1, 31, 10, 30)
    assert at(lambda x: S.add_to_date(x, "MM", 1)) == datetime(2024, 2, 29, 10, 30)
    assert at(lambda x: S.trunc_date(x, "HH24")) == datetime(2024, 1, 31, 10, 0)
    assert at(lambda x: S.date_diff(x, F.lit("2024-01-30").cast("timestamp_ntz"), "HH")) == 34.5


def test_number_cut_towards_zero(spark):
    cut = lambda p: value(spark, lambda x: S.trunc_number(x.cast("decimal(18,4)"), p).cast("double"), "-123.4567")
    assert (cut(2), cut(0), cut(-1)) == (-123.45, -123.0, -120.0)


def test_format_tokens():
    assert D.spark_format("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss" and D.spark_format("DD/MM/RR") == "dd/MM/yy"


@pytest.mark.parametrize("text, want", [
    ("2024-02-29", date(2024, 2, 29)), ("2023-02-29", None), ("20240101", date(2024, 1, 1)), (" 31/12/2024 ", date(2024, 12, 31)),
    ("2024.01.05", date(2024, 1, 5)), ("05.01.2024", date(2024, 1, 5)), ("05-01-2024", date(2024, 1, 5)), ("2024-1-5", None), ("", None), (None, None)])
def test_dates_in_several_formats(spark, text, want):
    assert value(spark, D.parse_date_multi, text) == want


@pytest.mark.parametrize("text, want", [
    ("2024-01-05-10.11.12", datetime(2024, 1, 5, 10, 11, 12)), ("20240105 10:11:12", datetime(2024, 1, 5, 10, 11, 12)),
    ("2024-01-05-10.11.12.123", datetime(2024, 1, 5, 10, 11, 12, 123000)), ("2024-01-05-10.11.12.123456", datetime(2024, 1, 5, 10, 11, 12, 123456)),
    ("01/05/2024 10:11:12", datetime(2024, 1, 5, 10, 11, 12)), ("25/12/2024 10:11:12", datetime(2024, 12, 25, 10, 11, 12)),
    ("2024-01-05T10:11:12", datetime(2024, 1, 5, 10, 11, 12)), ("2024-01-05 25.11.12", None)])
def test_timestamps_in_several_formats(spark, text, want):
    assert value(spark, D.parse_timestamp_multi, text) == want


@pytest.mark.parametrize("text, want", [("43m 31sec", 43 + 31 / 60.0), ("garbage", None), ("", None), (None, None), ("5m", None)])
def test_durations(spark, text, want):
    assert value(spark, D.parse_duration, text) == want


def test_time_and_sentinels(spark):
    assert value(spark, D.parse_time_multi, "10.11.12") == 36672 and value(spark, D.parse_time_multi, "25:00:00") is None
    assert value(spark, D.null_date_sentinels, " 00000000") is None and value(spark, lambda x: D.null_date_sentinels(x, months=True), "999912") is None
    assert value(spark, D.parse_year_month, "202402") == date(2024, 2, 1)
    assert value(spark, D.timestamp_border_cases, datetime(1, 1, 1, 1, 1, 1, 1), "timestamp_ntz") is None


def test_validations(spark):
    check = lambda rule, text: tuple(value(spark, rule, text))
    assert check(V.validate_num, " ") == (None, None) and check(V.validate_num, " 5") == (Decimal(5), None)
    assert check(V.validate_num, "5x") == (None, "ERROR_NUMBER|5x")
    assert check(lambda x: V.validate_num(x, not_null=True), None) == (None, "ERROR_NULL|")
    assert check(lambda x: V.validate_not_null(x, default="d"), "") == ("d", None)
    assert check(lambda x: V.validate_date(x, default=True), "") == (date(1900, 1, 1), None)
    assert check(lambda x: V.validate_decimal(x, 4, 2), "123.4") == (None, "ERROR_DECIMAL|123.4")


def test_row_validation_splits(spark, rows):
    df = spark.createDataFrame([(1, "5", "2024-01-01"), (2, "x|y", ""), (3, None, "bad")], "id int, n string, d string")
    good, bad = V.split(V.validate(df, {"n": V.num(F.col("n"), not_null=True), "d": V.date(F.col("d"))}), ["id"])
    assert rows(good, "id", "n", "d") == [(1, Decimal(5), date(2024, 1, 1))]
    assert rows(bad) == [(2, "n", "ERROR_NUMBER", "x|y"), (3, "d", "ERROR_DATE", "bad"), (3, "n", "ERROR_NULL", "")]
