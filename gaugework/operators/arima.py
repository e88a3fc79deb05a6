"""ARIMA(1,1,1) forecasts of every monthly series at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators.stl import monthly_series
from gaugework.session import spread


def arima_forecast(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    measures: Sequence[str],
    steps: int = 12,
    gaps: str = "collapse",
    more_than: int = 24,
) -> DataFrame:
    """Forecast of the next ``steps`` month ends per (keys…, measure), with standard errors.

    Fitted on monthly means, one series per Python call. Series with at most
    ``more_than`` months, or whose fit fails, give a single row with a status.
    """
    group = [*keys, "measure"]
    series = monthly_series(df, keys, time, measures, gaps)

    def forecast(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("month_end")
        key = {c: part[c].iloc[0] for c in group}
        last = part["month_end"].iloc[-1]
        nothing = {"last_month": last, "step": 0, "forecast": np.nan, "std_error": np.nan}
        if len(part) <= more_than:
            return pd.DataFrame([key | nothing | {"status": "too few points"}])
        try:
            mean, error = arima_111(part["value"].to_numpy(dtype=float), steps)
        except (ArithmeticError, ValueError) as problem:
            return pd.DataFrame([key | nothing | {"status": f"failed: {problem}"}])
        rows = {"last_month": last, "step": np.arange(1, steps + 1), "forecast": mean, "std_error": error}
        return pd.DataFrame(key | rows | {"status": "ok"})

    types = dict(series.dtypes)
    fields = [f"`{c}` {types[c]}" for c in group]
    schema = ", ".join([*fields, "last_month date, step int, forecast double, std_error double, status string"])
    fitted = spread(series, group).groupBy(*group).applyInPandas(forecast, schema)
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in ("forecast", "std_error")}
    month = F.when(F.col("step") > 0, F.last_day(F.add_months("last_month", F.col("step"))))
    return fitted.withColumns(numbers | {"month_end": month}).select(
        *group, "step", "month_end", "forecast", "std_error", "status"
    )


def _innovations(w: np.ndarray, phi: np.ndarray, theta: np.ndarray):
    """One-step errors of ARMA(1,1) for many (phi, theta) at once, by the innovations recursion."""
    scale = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    guess = np.zeros_like(phi)
    squares, logs = np.zeros_like(phi), np.zeros_like(phi)
    for value in w:
        error = value - guess
        squares += error**2 / scale
        logs += np.log(scale)
        guess = phi * value + theta / scale * error
        scale = 1 + theta**2 - theta**2 / scale
    return squares, logs, guess


STARTS = 6  # simplexes that run side by side
LAPS = 200


def _loss(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Twice the mean negative log likelihood, but for constants, at points in tanh scale."""
    squares, logs, _ = _innovations(w, *np.tanh(at).T)
    return np.log(np.maximum(squares / len(w), 1e-300)) + logs / len(w)


def _simplex(loss, corners: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """The best point that Nelder and Mead's search finds from several simplexes (starts × 3 × 2) at once.

    Every lap tries the four points of the method for all simplexes in one evaluation.
    """
    value = loss(corners.reshape(-1, 2)).reshape(len(corners), 3)
    for _ in range(LAPS):
        order = np.argsort(value, axis=1, kind="stable")
        corners, value = np.take_along_axis(corners, order[:, :, None], axis=1), np.take_along_axis(value, order, axis=1)
        size = np.abs(corners - corners[:, :1]).max(axis=(1, 2))
        if ((value[:, 2] - value[:, 0] <= tolerance) & (size <= 1e-7)).all():
            break
        middle, worst = corners[:, :2].mean(axis=1), corners[:, 2]
        # Reflected, expanded, contracted outside and inside.
        tried = middle[:, None] + np.array([1.0, 2.0, 0.5, -0.5])[None, :, None] * (middle - worst)[:, None]
        tried = np.clip(tried, -8.0, 8.0)
        got = loss(tried.reshape(-1, 2)).reshape(len(corners), 4)
        best, second, last = value.T
        far = (got[:, 0] < best) & (got[:, 1] < got[:, 0])
        outside = (got[:, 0] >= second) & (got[:, 0] < last)
        inside = got[:, 0] >= last
        pick = np.where(far, 1, np.where(inside, 3, np.where(outside, 2, 0)))
        here = np.arange(len(corners))
        better = got[here, pick] < np.where(outside, got[:, 0], np.where(inside, last, np.inf))
        corners[better, 2], value[better, 2] = tried[here, pick][better], got[here, pick][better]
        # Where a contraction does not help, the simplex shrinks towards its best corner.
        if not better.all():
            small = ~better
            corners[small, 1:] = (corners[small, 1:] + corners[small, :1]) / 2
            value[small, 1:] = loss(corners[small, 1:].reshape(-1, 2)).reshape(-1, 2)
    return corners.reshape(-1, 2)[np.argmin(value)]


def fit_arma_11(w: np.ndarray) -> tuple[float, float, float]:
    """phi, theta and variance that maximise the exact Gaussian likelihood.

    The likelihood may have several maxima and a ridge where phi and -theta nearly cancel, so simplex
    searches start from the lowest valleys of a coarse grid in tanh scale, until all have converged.
    """
    side = np.linspace(-3.0, 3.0, 25)
    grid = np.stack(np.meshgrid(side, side, indexing="ij"), axis=-1)
    loss = _loss(w, grid.reshape(-1, 2)).reshape(25, 25)
    padded = np.pad(loss, 1, constant_values=np.inf)
    around = np.min([padded[1 + i : 26 + i, 1 + j : 26 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
    # A valley is nowhere above its neighbours; the lowest point of the grid is always one.
    valleys = np.flatnonzero(loss <= around)
    valleys = valleys[np.argsort(loss.ravel()[valleys], kind="stable")][:STARTS]
    step = side[1] - side[0]
    corners = grid.reshape(-1, 2)[valleys][:, None, :] + step * np.array([[0.0, 0.0], [0.9, 0.3], [-0.3, 0.9]])
    phi, theta = np.tanh(_simplex(lambda at: _loss(w, at), corners))
    squares, _, _ = _innovations(w, np.array([phi]), np.array([theta]))
    return float(phi), float(theta), float(squares[0] / len(w))


def arima_111(y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and standard error of ARIMA(1,1,1) without constant."""
    if not np.isfinite(y).all():
        raise ValueError("series has missing values")
    w = np.diff(y)
    if not w.any():
        return np.full(steps, y[-1]), np.zeros(steps)
    size = float(np.std(w)) or 1.0
    phi, theta, variance = fit_arma_11(w / size)
    _, _, guess = _innovations(w / size, np.array([phi]), np.array([theta]))
    changes = float(guess[0]) * phi ** np.arange(steps) * size
    psi = np.concatenate([[1.0], (phi + theta) * phi ** np.arange(steps - 1)])
    spread = np.sqrt(variance * np.cumsum(np.cumsum(psi) ** 2)) * size
    return y[-1] + np.cumsum(changes), spread
