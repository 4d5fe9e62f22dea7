"""Data-quality validations.

A validation is a struct ``(value, error)``: blank input → NULL value, valid
input → typed value, invalid input → an error text ``code|raw``. `validate`
runs a set of them over a row, sets ``LOAD_DATA`` and gathers the errors;
`split` separates loadable rows from a long error table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import dates

# Error codes and the separator inside an error text.
ERROR_NUMBER = "ERROR_NUMBER"
ERROR_NULL = "ERROR_NULL"
ERROR_DATE = "ERROR_DATE"
ERROR_TIMESTAMP = "ERROR_TIMESTAMP"
ERROR_DECIMAL = "ERROR_DECIMAL"
SEPARATOR = "|"


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


@dataclass(frozen=True)
class Rule:
    """A field validation: the raw text, its typed value, and what to do with blanks."""

    raw: Column
    typed: Column
    code: str
    not_null: bool = False
    default: Column | None = None

    def value(self, typed: Column) -> Column:
        return F.when(blank(self.raw), F.lit(None) if self.default is None else self.default).otherwise(typed)

    def error(self, typed: Column) -> Column:
        missing = F.concat(F.lit(ERROR_NULL + SEPARATOR), F.coalesce(self.raw, F.lit("")))
        reject_blank = self.not_null and self.default is None
        return F.when(blank(self.raw), missing if reject_blank else F.lit(None)).when(
            typed.isNull(), F.concat(F.lit(self.code + SEPARATOR), self.raw))

    def struct(self) -> Column:
        return F.struct(self.value(self.typed).alias("value"), self.error(self.typed).alias("error"))


def num(c: Column, not_null: bool = False) -> Rule:
    return Rule(c, F.trim(c).try_cast("decimal(38,9)"), ERROR_NUMBER, not_null)


def present(c: Column, default: str | None = None) -> Rule:
    return Rule(c, c, ERROR_NULL, True, None if default is None else F.lit(default))


def date(c: Column, formats: list[str] | None = None, not_null: bool = False, default: bool = False) -> Rule:
    """``default`` fills blanks with the default date."""
    fallback = dates.parse_date_multi(F.lit(dates.DEFAULT_DATE), ["yyyyMMdd"]) if default else None
    return Rule(c, dates.parse_date_multi(c, formats), ERROR_DATE, not_null, fallback)


def timestamp(c: Column, formats: list[str] | None = None, not_null: bool = False) -> Rule:
    return Rule(c, dates.parse_timestamp_multi(c, formats), ERROR_TIMESTAMP, not_null)


def decimal(c: Column, precision: int, scale: int) -> Rule:
    """The value must fit the declared integer digits; extra decimals are rounded."""
    return Rule(c, F.trim(c).try_cast(f"decimal({precision},{scale})"), ERROR_DECIMAL)


def validate_num(c: Column, not_null: bool = False) -> Column:
    return num(c, not_null).struct()


def validate_not_null(c: Column, default: str | None = None) -> Column:
    return present(c, default).struct()


def validate_date(c: Column, formats: list[str] | None = None, not_null: bool = False, default: bool = False) -> Column:
    return date(c, formats, not_null, default).struct()


def validate_timestamp(c: Column, formats: list[str] | None = None, not_null: bool = False) -> Column:
    return timestamp(c, formats, not_null).struct()


def validate_decimal(c: Column, precision: int, scale: int) -> Column:
    return decimal(c, precision, scale).struct()


def validate(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Run all field validations of a row.

    The field takes the typed value, ``errors`` holds one ``field|code|raw`` text for each failure,
    and ``LOAD_DATA`` is Y or N. Typed values get a projection of their own, so each text is parsed once.
    """
    typed = df.withColumns({f"_typed_{n}": r.typed for n, r in rules.items()})
    errors = F.array_compact(F.array(*[
        F.concat(F.lit(n + SEPARATOR), r.error(F.col(f"_typed_{n}"))) for n, r in rules.items()]))
    checked = typed.withColumns({"errors": errors} | {f"_out_{n}": r.value(F.col(f"_typed_{n}")) for n, r in rules.items()})
    kept = [F.col(f"_out_{c}").alias(c) if c in rules else F.col(f"`{c}`") for c in df.columns]
    added = [F.col(f"_out_{n}").alias(n) for n in rules if n not in df.columns]
    return checked.select(*kept, *added, "errors", F.when(F.size("errors") == 0, "Y").otherwise("N").alias("LOAD_DATA"))


def split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, error table ``keys + field, code, raw``) of a validated table."""
    # Both sides come from one outer explode, which gives a good row a NULL error. A filter on LOAD_DATA or a plain
    # explode would be pushed below the validations and run them again.
    each = df.withColumn("error", F.explode_outer("errors"))
    good = each.filter(F.col("error").isNull()).drop("error", "errors", "LOAD_DATA")
    parts = F.split("error", r"\|", 3)
    bad = (each.filter(F.col("error").isNotNull())
           .select(*keys, parts[0].alias("field"), parts[1].alias("code"), parts[2].alias("raw")))
    return good, bad


def quality_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row a rule with the number of rows that pass, fail or cannot tell (NULL); one pass, one row shuffled a task."""
    counts = df.agg(*[F.count_if(c).alias(f"{n}_pass") for n, c in rules.items()],
                    *[F.count_if(~c).alias(f"{n}_fail") for n, c in rules.items()],
                    *[F.count_if(c.isNull()).alias(f"{n}_unknown") for n, c in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_pass").alias("passed"),
                              F.col(f"{n}_fail").alias("failed"), F.col(f"{n}_unknown").alias("unknown"))
                     for n in rules])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
