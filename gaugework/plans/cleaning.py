"""From raw text to the clean wide table, and its long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gaugework.operators.cleaning import (
    add_date_parts,
    drop_missing,
    impute_mean,
    melt,
    normalize_missing,
    resolve_time,
    to_numbers,
)


def clean_observations(
    raw: DataFrame,
    measures: Sequence[str],
    time: str = "date",
    sampled: str = "sampling_date",
    required: Sequence[str] = (),
) -> DataFrame:
    """Missing texts → null, dates and numbers parsed, date parts added, gaps imputed.

    The means used for imputation include the rows that lack a ``required`` column;
    those rows are dropped afterwards.
    """
    wide = resolve_time(normalize_missing(raw), time, sampled)
    wide = add_date_parts(wide, sampled if sampled in wide.columns else time)
    wide = impute_mean(to_numbers(wide, measures), measures)
    return drop_missing(wide, required) if required else wide


def long_form(wide: DataFrame, measures: Sequence[str], ids: Sequence[str]) -> DataFrame:
    return melt(wide, ids, measures)
