"""Null-safe and ANSI-safe arithmetic on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col_of(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: str | Column) -> Column:
    """NaN counts as missing everywhere; Spark's own averages would return NaN."""
    c = col_of(value)
    return F.when(~F.isnan(c), c)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null on zero."""
    return F.try_divide(top, bottom)


def pair_corr(a: str | Column, b: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over the rows where both sides are present; null when a side is constant.

    The built-in ``corr`` raises on zero variance under ANSI mode, so it is composed
    from covariance and standard deviations instead.
    """
    left, right = col_of(a), col_of(b)
    both = left.isNotNull() & right.isNotNull()
    x, y = F.when(both, left), F.when(both, right)
    parts = [F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    cov, sx, sy = parts
    return ratio(cov, sx * sy)


def all_present(columns: Iterable[str]) -> Column:
    """True where no listed column is null; grouped operators drop null keys with it."""
    out = F.lit(True)
    for name in columns:
        out = out & F.col(name).isNotNull()
    return out


def with_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows whose keys are all present."""
    keys = list(keys)
    return df.where(all_present(keys)) if keys else df


def window_by(keys: Iterable[str], *order) -> WindowSpec:
    return Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
