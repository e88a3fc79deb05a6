"""Dates: lenient parsing, calendar parts, month ends and wall-clock arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.functions.safe import col_of

# The month-code format "M%m%Y" and the day-first formats accepted.
MONTH_CODE = r"(?i)^\s*M(1[0-2]|0[1-9]|[1-9])(\d{4})\s*$"
DAY_FIRST_FORMATS = ("d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "yyyy-M-d H:m:s")
MONTH_FIRST_FORMATS = ("M-d-yyyy", "M/d/yyyy", "yyyy-M-d", "yyyy-M-d H:m:s")


def parse_month_code(value: str | Column) -> Column:
    """``February - M021990`` → 1990-02-01; anything else → null."""
    tail = F.element_at(F.split(col_of(value), "-"), -1)
    month = F.nullif(F.regexp_extract(tail, MONTH_CODE, 1), F.lit(""))
    year = F.nullif(F.regexp_extract(tail, MONTH_CODE, 2), F.lit(""))
    text = F.concat(year, F.lit("-"), month, F.lit("-1"))
    return F.try_to_date(text, "yyyy-M-d").cast("timestamp_ntz")


def parse_date(value: str | Column, formats: Sequence[str] | None = None, day_first: bool = True) -> Column:
    """First format that parses wins; unparseable text → null."""
    if formats is None:
        formats = DAY_FIRST_FORMATS if day_first else MONTH_FIRST_FORMATS
    text = F.trim(col_of(value))
    # Dates are read as dates, so that no time zone gets a say.
    tries = [F.try_to_timestamp(text, F.lit(f)) if "H" in f else F.try_to_date(text, f) for f in formats]
    return F.coalesce(*[t.cast("timestamp_ntz") for t in tries])


def date_parts(value: str | Column) -> dict[str, Column]:
    c = col_of(value)
    return {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c)}


def month_end(value: str | Column) -> Column:
    """Label of the calendar month: its last day, as a date."""
    return F.last_day(col_of(value))


def add_days(value: str | Column, days: int) -> Column:
    return col_of(value) + F.expr(f"INTERVAL {int(days)} DAYS")


def wall_micros(value: str | Column) -> Column:
    """Microseconds since 1970-01-01 on the wall clock, independent of any time zone."""
    elapsed = col_of(value).cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    seconds = elapsed.cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("long")
