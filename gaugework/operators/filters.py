"""Predicates, option lists and minimum-data gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.safe import with_keys
from gaugework.operators.joins import attach, one_row


@dataclass(frozen=True)
class Selection:
    """What a user picked: allowed values per column, and a time range."""

    members: dict[str, Sequence[Any]] = field(default_factory=dict)
    time: str | None = None
    start: Any = None
    end: Any = None


def filter_in(df: DataFrame, column: str, values: Sequence[Any] | DataFrame) -> DataFrame:
    """Keep rows whose column is one of the values (a list, or a one-column table)."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(*values))


def filter_between(df: DataFrame, time: str, start: Any, end: Any) -> DataFrame:
    """Inclusive at both ends."""
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))


def filter_eq(df: DataFrame, **equals: Any) -> DataFrame:
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def apply_selection(df: DataFrame, selection: Selection) -> DataFrame:
    for name, values in selection.members.items():
        df = filter_in(df, name, values)
    if selection.time is None:
        return df
    if selection.start is not None:
        df = df.where(F.col(selection.time) >= F.lit(selection.start))
    if selection.end is not None:
        df = df.where(F.col(selection.time) <= F.lit(selection.end))
    return df


def options(df: DataFrame, column: str, first: int | None = None) -> DataFrame:
    """Sorted distinct values of a column, or only the first few as a default choice."""
    found = with_keys(df, [column]).select(column).distinct().orderBy(column)
    return found if first is None else found.limit(first)


def time_bounds(df: DataFrame, time: str) -> DataFrame:
    """First and last time, in one row."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def last_period(df: DataFrame, time: str, count: int, unit: str) -> DataFrame:
    """Rows within the period that ends at the latest time of the table."""
    latest = one_row(df.agg(F.max(time).alias("last")))["last"]
    return df.where(F.col(time) >= latest - _interval(count, unit))


def last_periods(df: DataFrame, time: str, periods: dict[str, tuple[int, str]], name: str = "period") -> DataFrame:
    """Rows of several periods that end at the latest time, each row once per period it lies in.

    One maximum and one pass over the rows serve all periods.
    """
    latest = one_row(df.agg(F.max(time).alias("last")))["last"]
    inside = {label: F.col(time) >= latest - _interval(count, unit) for label, (count, unit) in periods.items()}
    tags = [F.when(test, F.lit(label)) for label, test in inside.items()]
    # Rows of no period are left out before any list is made.
    return df.where(reduce(or_, inside.values())).withColumn(name, F.explode(F.array_compact(F.array(*tags))))


def _interval(count: int, unit: str) -> Column:
    if unit.lower().rstrip("s") not in ("day", "month", "year"):
        raise ValueError(f"unknown unit {unit!r}")
    return F.expr(f"INTERVAL {int(count)} {unit}")


def gate(df: DataFrame, keys: Sequence[str], more_than: int) -> DataFrame:
    """Mark each row by whether its series has more than ``more_than`` rows; nothing is dropped."""
    counts = with_keys(df, keys).groupBy(*keys).agg(F.count("*").alias("points"))
    status = F.when(F.col("points") > more_than, "ok").otherwise("too few points")
    return attach(df, counts, keys).withColumn("status", status)
