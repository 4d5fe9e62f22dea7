"""The recipe expression vocabulary as Spark Columns.

Every function is a composition of built-in expressions, so a projection stays
inside whole-stage codegen and filters still reach the scan. Parsing never
throws: bad input is NULL.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import dates

TEXT = "string"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- conversion -------------------------------------------------------------


def to_date(s: Column, fmt: str) -> Column:
    return dates.parse(s, dates.spark_format(fmt))


def is_date(s: Column, fmt: str = "MM/DD/YYYY HH24:MI:SS") -> Column:
    return to_date(s, fmt).isNotNull()


def to_char(x: Column, fmt: str | None = None) -> Column:
    return x.cast(TEXT) if fmt is None else F.date_format(x, dates.spark_format(fmt))


def to_decimal(x: Column, scale: int = 9) -> Column:
    return F.trim(x.cast(TEXT)).try_cast(f"decimal(38,{scale})")


def to_integer(x: Column) -> Column:
    """Truncates towards zero."""
    number = F.trim(x.cast(TEXT)).try_cast("decimal(38,18)")
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("int")


def to_number(s: Column) -> Column:
    return s.try_cast("decimal(38,9)")


def is_number(s: Column) -> Column:
    return F.trim(s).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


# --- text -------------------------------------------------------------------


def lpad(s: Column, n, pad=" ") -> Column:
    return F.lpad(s, lit(n), lit(pad))


def rpad(s: Column, n, pad=" ") -> Column:
    return F.rpad(s, lit(n), lit(pad))


def substr(s: Column, start, length=None) -> Column:
    """1-based; 0 reads as 1; a negative start counts from the end. Start and length may be computed."""
    start = F.when(lit(start) == 0, 1).otherwise(lit(start)) if isinstance(start, Column) else F.lit(start or 1)
    return F.substring(s, start.cast("int"), lit(2**31 - 1 if length is None else length).cast("int"))


def replace_chr(case_sensitive: bool, s: Column, old: str, new: str) -> Column:
    """Replace each character of ``old`` by ``new`` (which may be empty or longer)."""
    flags = "" if case_sensitive else "(?i)"
    chars = "".join(re.escape(ch) for ch in old)
    return F.regexp_replace(s, f"{flags}[{chars}]", _literal_replacement(new)) if old else s


def replace_str(case_sensitive: bool, s: Column, olds: list[str], new: str) -> Column:
    """Replace every occurrence of any of ``olds``; at one position the earlier listed wins."""
    flags = "" if case_sensitive else "(?i)"
    choices = "|".join(re.escape(o) for o in olds if o)
    return F.regexp_replace(s, f"{flags}(?:{choices})", _literal_replacement(new)) if choices else s


def _literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def concat(a: Column, b: Column) -> Column:
    """NULL counts as empty unless both sides are NULL."""
    a, b = a.cast(TEXT), b.cast(TEXT)
    return F.when(a.isNotNull() | b.isNotNull(), F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def length(s: Column) -> Column:
    return F.length(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def trim(s: Column) -> Column:
    return F.trim(s)


def ltrim(s: Column) -> Column:
    return F.ltrim(s)


def rtrim(s: Column) -> Column:
    return F.rtrim(s)


def instr(s: Column, sub, start=1, occurrence: int = 1) -> Column:
    """Position of the n-th occurrence at or after ``start``; 0 when there is none.

    A negative start counts from the end, and the search goes backwards from there. ``sub`` and ``start`` may be computed.
    """
    sub = lit(sub)

    def nth(text: Column, part: Column, first: Column) -> Column:
        pos = F.position(part, text, first)
        for _ in range(occurrence - 1):
            pos = F.when(pos > 0, F.position(part, text, pos + 1)).otherwise(F.lit(0))
        return pos

    def back(first: Column) -> Column:
        found = nth(F.reverse(s), F.reverse(sub), F.greatest(F.lit(1), -first - F.length(sub) + 1))
        return F.when(found > 0, F.length(s) - found - F.length(sub) + 2).otherwise(found)

    if not isinstance(start, Column):
        return back(F.lit(start)) if start < 0 else nth(s, sub, F.lit(start))
    start = start.cast("int")
    return F.when(start < 0, back(start)).otherwise(nth(s, sub, start))


def is_spaces(s: Column) -> Column:
    return (F.length(s) > 0) & (F.trim(s) == "")


def chr_(n: Column) -> Column:
    return F.chr(n)


def reg_match(s: Column, pattern, anchored: bool = True) -> Column:
    if isinstance(pattern, Column):
        return F.rlike(s, F.concat(F.lit("^(?:"), pattern, F.lit(")$")) if anchored else pattern)
    return s.rlike(f"^(?:{pattern})$" if anchored else pattern)


def regexp_like(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def reg_replace(s: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(s, pattern, replacement)


def _accented() -> tuple[str, str]:
    """Every letter that is one plain letter plus combining marks, and that plain letter."""
    plain = {}
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all("\u0300" <= m <= "\u036f" for m in marks):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accented()


def latin_to_ascii(s: Column) -> Column:
    """Letters without their diacritics; free combining marks are dropped."""
    return F.regexp_replace(F.translate(s, ACCENTED, PLAIN), "[\\u0300-\\u036F]", "")


# --- numbers ----------------------------------------------------------------


def abs_(x: Column) -> Column:
    return F.abs(x)


def round_(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def trunc_number(x: Column, precision: int = 0) -> Column:
    """Cut, not round, at ``precision`` decimals; exact for decimals."""
    factor = F.lit(10 ** abs(precision))
    scaled = x * factor if precision >= 0 else x / factor
    whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return whole / factor if precision >= 0 else whole * factor


def greatest(*xs: Column) -> Column:
    return F.greatest(*xs)


def least(*xs: Column) -> Column:
    return F.least(*xs)


# --- dates ------------------------------------------------------------------

# Mapping date-part names and the Spark unit they mean.
DATE_PARTS = {
    "Y": "YEAR", "YY": "YEAR", "YYYY": "YEAR", "MM": "MONTH", "MON": "MONTH", "MONTH": "MONTH",
    "D": "DAY", "DD": "DAY", "DDD": "DAY", "DY": "DAY", "DAY": "DAY",
    "HH": "HOUR", "HH12": "HOUR", "HH24": "HOUR", "MI": "MINUTE", "SS": "SECOND",
}
UNIT_SECONDS = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}


def trunc_date(d: Column, part: str = "DD") -> Column:
    return F.date_trunc(DATE_PARTS[part.upper()].lower(), d).cast("timestamp_ntz")


def add_to_date(d: Column, part: str, n) -> Column:
    """Move ``d`` by ``n`` units; month ends are clipped, not carried over."""
    unit = DATE_PARTS[part.upper()]
    n = lit(n).cast("int")
    step = {
        "YEAR": lambda: F.make_interval(years=n),
        "MONTH": lambda: F.make_interval(months=n),
        "DAY": lambda: F.make_interval(days=n),
        "HOUR": lambda: F.make_interval(hours=n),
        "MINUTE": lambda: F.make_interval(mins=n),
        "SECOND": lambda: F.make_interval(secs=n.cast("decimal(18,6)")),
    }[unit]
    return d + step()


def last_day(d: Column) -> Column:
    """Last day of the month, time of day kept."""
    start = F.date_trunc("month", d).cast("timestamp_ntz")
    return start + F.make_interval(months=F.lit(1), days=F.lit(-1)) + (d - F.date_trunc("day", d).cast("timestamp_ntz"))


def date_diff(d1: Column, d2: Column, part: str) -> Column:
    """``d1 - d2`` in units of ``part``; fractional."""
    unit = DATE_PARTS[part.upper()]
    if unit in ("YEAR", "MONTH"):
        months = F.months_between(d1, d2, roundOff=False)
        return months / 12 if unit == "YEAR" else months
    seconds = (F.unix_micros(d1.cast("timestamp")) - F.unix_micros(d2.cast("timestamp"))) / F.lit(1e6)
    return seconds / UNIT_SECONDS[unit]


def get_date_part(d: Column, part: str) -> Column:
    return F.date_part(F.lit(DATE_PARTS[part.upper()]), d).cast("int")


def sysdate(now=None) -> Column:
    """Current timestamp; pass ``now`` to fix it."""
    return F.current_timestamp() if now is None else lit(now).cast("timestamp_ntz")


# --- logic ------------------------------------------------------------------


def isnull(x: Column) -> Column:
    return x.isNull()


def in_(v: Column, *choices) -> Column:
    return v.isin([c for c in choices])


def iif(cond: Column, a, b=None) -> Column:
    """A NULL condition takes the else branch."""
    return F.when(cond, lit(a)).otherwise(lit(b))


def decode(v: Column, *args) -> Column:
    """``decode(v, s1, r1, s2, r2, …[, default])``; NULL matches NULL."""
    pairs, default = (args[:-1], args[-1]) if len(args) % 2 else (args, None)
    branches = [(v.eqNullSafe(lit(s)), lit(r)) for s, r in zip(pairs[::2], pairs[1::2])]
    return reduce(lambda rest, b: F.when(b[0], b[1]).otherwise(rest), reversed(branches), lit(default))


def nvl(a: Column, b) -> Column:
    return F.coalesce(a, lit(b))


def not_(x: Column) -> Column:
    return ~x


ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
}
COMPARISON = {
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "^=": lambda a, b: a != b,
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
}
LOGICAL = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b}


def arithmetic(a: Column, op: str, b: Column) -> Column:
    return ARITHMETIC[op](a, b)


def comparison(a: Column, op: str, b: Column) -> Column:
    return COMPARISON[op](a, b)


def logical(a: Column, op: str, b: Column) -> Column:
    return LOGICAL[op.strip().upper()](a, b)
