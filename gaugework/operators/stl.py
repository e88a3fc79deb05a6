"""Seasonal-trend decomposition by loess (Cleveland et al., 1990) of every series at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.aggregates import monthly_mean
from gaugework.operators.windows import complete_months
from gaugework.session import spread


def monthly_series(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    measures: Sequence[str],
    gaps: str = "collapse",
) -> DataFrame:
    """Monthly means per (keys…, measure).

    ``gaps="collapse"`` leaves missing months out, ``"fill"`` completes the calendar.
    """
    monthly = monthly_mean(df, keys, time, measures)
    if gaps == "collapse":
        return monthly
    if gaps == "fill":
        return complete_months(monthly, [*keys, "measure"])
    raise ValueError(f"unknown gaps {gaps!r}")


def stl(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    measures: Sequence[str],
    period: int = 12,
    seasonal: int = 13,
    robust: bool = True,
    gaps: str = "collapse",
    more_than: int = 24,
) -> DataFrame:
    """observed = trend + seasonal + resid for every (keys…, measure).

    Spark reduces the rows to one per month first, so a group handed to Python is as
    long as its calendar. Series with at most ``more_than`` months come back with
    their observed values and a status instead of a decomposition.
    """
    group = [*keys, "measure"]
    series = monthly_series(df, keys, time, measures, gaps)

    def decompose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("month_end")
        out = part[[*group, "month_end"]].copy()
        y = part["value"].to_numpy(dtype=float)
        out["observed"], out["trend"], out["seasonal"], out["resid"] = y, np.nan, np.nan, np.nan
        out["status"] = "too few points"
        if len(y) > more_than:
            try:
                trend, season = stl_fit(y, period, seasonal, robust)
            except (ArithmeticError, ValueError):
                trend = season = np.full(len(y), np.nan)
            fine = bool(np.isfinite(trend).all() and np.isfinite(season).all())
            out["status"] = "ok" if fine else "failed"
            if fine:
                out["trend"], out["seasonal"], out["resid"] = trend, season, y - trend - season
        return out

    types = dict(series.dtypes)
    fields = [f"`{c}` {types[c]}" for c in [*group, "month_end"]]
    fields += [f"{c} double" for c in ("observed", "trend", "seasonal", "resid")] + ["status string"]
    fitted = spread(series, group).groupBy(*group).applyInPandas(decompose, ", ".join(fields))
    parts = {c: F.when(~F.isnan(c), F.col(c)) for c in ("trend", "seasonal", "resid")}
    return fitted.withColumns(parts)


def loess(y: np.ndarray, span: int, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local linear fit of y (at positions 1…n) evaluated at the positions ``at``."""
    n = len(y)
    width = min(span, n)
    first = np.clip(at.astype(int) - (span + 1) // 2, 0, n - width)
    near = first[:, None] + np.arange(width)
    x = near + 1.0
    reach = np.maximum(at - x[:, 0], x[:, -1] - at) + max(0, (span - n) // 2)
    distance = np.abs(x - at[:, None])
    scaled = distance / np.maximum(reach, 1e-300)[:, None]
    kernel = np.where(scaled <= 0.999, (1 - np.minimum(scaled, 1) ** 3) ** 3, 0.0)
    kernel = np.where(scaled <= 0.001, 1.0, kernel) * weights[near]
    total = kernel.sum(axis=1)
    share = kernel / np.where(total > 0, total, 1)[:, None]
    centre = (share * x).sum(axis=1)
    spread = (share * (x - centre[:, None]) ** 2).sum(axis=1)
    tilt = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / np.where(spread > 0, spread, 1), 0.0)
    fit = (share * (1 + tilt[:, None] * (x - centre[:, None])) * y[near]).sum(axis=1)
    # Where robustness removed all neighbours the nearest smoothed value stands in.
    known = np.flatnonzero(total > 0)
    if not len(known):
        return y[np.clip(at.astype(int) - 1, 0, n - 1)]
    after = np.clip(np.searchsorted(known, np.arange(len(at))), 0, len(known) - 1)
    before = np.maximum(after - 1, 0)
    here = np.arange(len(at))
    nearest = np.where(np.abs(known[before] - here) <= np.abs(known[after] - here), known[before], known[after])
    return np.where(total > 0, fit, fit[nearest])


def _moving_average(y: np.ndarray, length: int) -> np.ndarray:
    return np.convolve(y, np.full(length, 1.0 / length), "valid")


def stl_fit(y: np.ndarray, period: int, seasonal: int, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal component of one regular series."""
    n = len(y)
    odd = lambda v: int(v) + 1 - int(v) % 2
    trend_span = odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    low_span = odd(period)
    inner, outer = (2, 15) if robust else (5, 0)
    everywhere = np.arange(1, n + 1, dtype=float)
    ones, weights = np.ones(n + 2 * period), np.ones(n)
    trend, season = np.zeros(n), np.zeros(n)
    for lap in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                sub = detrended[phase::period]
                # One period is added at both ends.
                places = np.arange(0, len(sub) + 2, dtype=float)
                cycle[phase::period][: len(places)] = loess(sub, seasonal, weights[phase::period], places)
            smooth = _moving_average(_moving_average(_moving_average(cycle, period), period), 3)
            low = loess(smooth, low_span, ones, everywhere)
            season = cycle[period : period + n] - low
            trend = loess(y - season, trend_span, weights, everywhere)
        if lap < outer:
            off = np.abs(y - season - trend)
            limit = 6 * np.median(off)
            # What is left at rounding level says nothing about outliers.
            if limit <= 1e-12 * np.abs(y).max():
                weights = np.ones(n)
                continue
            u = off / limit
            weights = np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0)
            weights = np.where(u <= 0.001, 1.0, weights)
    return trend, season
