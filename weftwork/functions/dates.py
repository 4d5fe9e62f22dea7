"""Date and time parsing with several accepted formats, sentinels and durations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats and sentinels.
DATE_FORMATS = ["yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy", "yyyy.MM.dd", "dd.MM.yyyy", "dd-MM-yyyy", "ddMMyyyy", "ddMMy"]
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd-HH.mm.ss",
    "yyyy-MM-dd-HH:mm:ss",
    "yyyy-MM-dd HH.mm.ss",
    "yyyyMMdd HH:mm:ss",
    "yyyy.MM.dd HH:mm:ss",
    "yyyy.MM.dd HH.mm.ss",
    "yyyy.MM.dd.HH:mm:ss",
    "yyyy.MM.dd.HH.mm.ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd-HH.mm.ss.SSS",
    "yyyy-MM-dd-HH.mm.ss.SSSSSS",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
]
TIME_FORMATS = ["HH.mm.ss", "HH:mm:ss"]
NULL_DATES = ["00000000", "0000000000", "0", "00.00.0000", "99991231"]
NULL_MONTHS = ["000000", "000101", "999912", "00000", "0"]
BORDER_TIMESTAMPS = [
    "0001-01-01 00:00:00",
    "0001-01-01 01:00:00",
    "0001-01-01 01:01:01.000001",
    "0001-01-01 00:00:00.000001",
]
DEFAULT_DATE = "19000101"
# How mapping date-format tokens read as Spark datetime letters.
FORMAT_TOKENS = {
    "YYYY": "yyyy", "RRRR": "yyyy", "YY": "yy", "RR": "yy", "Y": "y", "MM": "MM", "MON": "MMM", "MONTH": "MMMM", "DDD": "DDD", "DD": "dd", "D": "d",
    "DY": "EEE", "DAY": "EEEE", "HH24": "HH", "HH12": "hh", "HH": "HH", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "NS": "SSSSSSSSS",
    "AM": "a", "PM": "a", "A.M.": "a", "P.M.": "a", "T": "'T'",
}
# How month, day and half-day names begin in the texts that Spark reads.
NAMES = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun AM PM".split()
_TOKEN = re.compile("|".join(re.escape(t) for t in sorted(FORMAT_TOKENS, key=len, reverse=True)) + r"|'[^']*'|[^A-Za-z']+", re.IGNORECASE)


def spark_format(mapping_format: str) -> str:
    """``YYYY-MM-DD HH24:MI:SS`` → ``yyyy-MM-dd HH:mm:ss``. Tokens are read without regard to case, the longest first.

    HH beside AM or PM is the half-day hour. An unknown token, such as the Julian day, is an error when the plan is built.
    """
    half, out, at = re.search(r"[AP]\.?M\.?", mapping_format, re.IGNORECASE), [], 0
    while at < len(mapping_format):
        found = _TOKEN.match(mapping_format, at)
        if not found:
            raise ValueError(f"unknown date format token at {mapping_format[at:]!r} in {mapping_format!r}")
        token = FORMAT_TOKENS.get(found[0].upper(), found[0])
        out.append("hh" if half and found[0].upper() == "HH" else token)
        at = found.end()
    return "".join(out)


def shape(fmt: str) -> str:
    """Regular expression of the texts a Spark pattern can read, with fixed digit counts.

    Trying formats on text they cannot read costs an exception each; the shape is
    checked first, so usually one format is tried at all.
    """
    out = []
    for run in re.finditer(r"'([^']*)'|([A-Za-z])\2*|[^A-Za-z']+", fmt):
        text, letter = run.group(0), run.group(2)
        if letter is None:
            out.append(re.escape(run.group(1) if run.group(1) is not None else text))
        elif letter in "yu" and len(text) == 1:
            out.append(r"\d+")
        elif letter in "yuMdHhmsS" and not (letter == "M" and len(text) > 2):
            out.append(rf"\d{{{len(text)}}}" if len(text) > 1 else r"\d{1,2}")
        else:
            out.append(".+")
    return "^" + "".join(out) + "$"


def parse(c: Column, fmt: str) -> Column:
    """Timestamp without zone, or NULL when the text does not fit ``fmt`` (a Spark pattern)."""
    text = F.trim(c)
    if re.search("MMM|EEE|a", re.sub("'[^']*'", "", fmt)):  # names are read in any case
        text = F.lower(text)
        for name in NAMES:
            text = F.regexp_replace(text, rf"\b{name.lower()}" + (r"\b" if name.isupper() else ""), name)
    return F.when(text.rlike(shape(fmt)), F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))


def first_parse(c: Column, formats: list[str]) -> Column:
    """The first format that fits wins; NULL when none does."""
    return F.coalesce(*[parse(c, f) for f in formats])


def parse_date_multi(c: Column, formats: list[str] | None = None) -> Column:
    return first_parse(c, formats or DATE_FORMATS).cast("date")


def parse_timestamp_multi(c: Column, formats: list[str] | None = None) -> Column:
    return first_parse(c, formats or TIMESTAMP_FORMATS)


def parse_year_month(c: Column, formats: list[str] | None = None) -> Column:
    """First day of the month."""
    return first_parse(c, formats or ["yyyyMM"]).cast("date")


def parse_time_multi(c: Column, formats: list[str] | None = None) -> Column:
    """Seconds since midnight as an integer (Spark's TIME type is off by default)."""
    t = first_parse(c, formats or TIME_FORMATS)
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("int")


def null_date_sentinels(c: Column, months: bool = False) -> Column:
    """Placeholder dates (or months) become NULL."""
    return F.when(F.trim(c).isin(NULL_MONTHS if months else NULL_DATES), F.lit(None)).otherwise(c)


def timestamp_border_cases(ts: Column) -> Column:
    """Year-1 placeholder timestamps become NULL."""
    return F.when(ts.cast("timestamp_ntz").isin([F.lit(v).cast("timestamp_ntz") for v in BORDER_TIMESTAMPS]),
                  F.lit(None)).otherwise(ts)


def duration_seconds(c: Column) -> Column:
    """``14m 05sec`` → 845; anything else NULL."""
    shape = r"^(\d+)m\s+(\d+)sec$"
    text = F.trim(c)
    part = lambda i: F.regexp_extract(text, shape, i).try_cast("bigint")
    return F.when(text.rlike(shape), part(1) * 60 + part(2))


def parse_duration(c: Column) -> Column:
    """``14m 05sec`` → minutes as a double; anything else NULL."""
    shape = r"^(\d+)m\s+(\d+)sec$"
    text = F.trim(c)
    part = lambda i: F.regexp_extract(text, shape, i).try_cast("bigint")
    return F.when(text.rlike(shape), part(1) + part(2) / F.lit(60.0))
