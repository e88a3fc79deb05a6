"""Missing values, types, imputation and reshaping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.safe import nan_to_null
from gaugework.functions.scalars import to_number
from gaugework.functions.temporal import add_days, date_parts, parse_date, parse_month_code
from gaugework.operators.joins import one_row

# Texts that a CSV reader takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def normalize_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing-value texts and NaN become null, in every column."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype == "string":
            c = F.when(~F.trim(c).isin(*tokens), c)
        elif dtype in ("double", "float"):
            c = nan_to_null(c)
        out.append(c.alias(name))
    return df.select(*out)


def to_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def resolve_time(df: DataFrame, time: str = "date", fallback: str = "sampling_date") -> DataFrame:
    """Parse both time columns; a missing ``time`` column is copied from ``fallback``.

    ``fallback`` accepts month codes as well as day-first dates.
    """
    if time not in df.columns and fallback not in df.columns:
        raise ValueError(f"neither {time!r} nor {fallback!r} is present")
    if fallback in df.columns and dict(df.dtypes)[fallback] == "string":
        df = df.withColumn(fallback, F.coalesce(parse_month_code(fallback), parse_date(fallback)))
    if time not in df.columns:
        return df.withColumn(time, F.col(fallback))
    if dict(df.dtypes)[time] == "string":
        df = df.withColumn(time, parse_date(time))
    return df


def add_date_parts(df: DataFrame, time: str) -> DataFrame:
    """year, month and day columns; null where the time is null."""
    return df.withColumns(date_parts(time))


def impute_mean(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Nulls take the mean of the whole column; a column without any value stays null.

    All means come from one aggregate, read back as a single row.
    """
    clean = {m: nan_to_null(F.col(m).cast("double")) for m in measures}
    means = one_row(df.agg(*[F.avg(c).alias(m) for m, c in clean.items()]))
    return df.withColumns({m: F.coalesce(c, means[m]) for m, c in clean.items()})


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def melt(
    df: DataFrame,
    ids: Sequence[str],
    measures: Sequence[str],
    measure_name: str = "measure",
    value_name: str = "value",
    dtype: str = "double",
) -> DataFrame:
    """Wide → long, without the null values.

    Written as an inlined array: unlike an unpivot, Catalyst recognises it again in a
    plan that uses the long table twice, so that kept results and shuffles are reused.
    """
    cells = [F.struct(F.lit(m).alias(measure_name), F.col(m).cast(dtype).alias(value_name)) for m in measures]
    return df.select(*ids, F.inline(F.array(*cells))).where(F.col(value_name).isNotNull())


def melt_matrix(df: DataFrame, ids: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Every column that is not an id becomes a row; empty cells are kept."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], name, value)


def add_interval(df: DataFrame, time: str, days: int = 10, start: str = "start", end: str = "end") -> DataFrame:
    """A bar of fixed length that begins at ``time``."""
    return df.withColumns({start: F.col(time), end: add_days(time, days)})


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns, so that the scan reads no others."""
    return df.select(*columns)
