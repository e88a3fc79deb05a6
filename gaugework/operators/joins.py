"""Lookups, semi joins and one-row results used as scalars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.safe import with_keys
from gaugework.session import settle


def one_row(aggregate: DataFrame) -> Column:
    """The single row of an ungrouped aggregate as a struct column (a scalar subquery, no join)."""
    return aggregate.select(F.struct(*aggregate.columns).alias("row")).scalar()


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Attach the columns of ``dim``; rows without a match are dropped.

    No broadcast is forced: Catalyst broadcasts ``dim`` when its size is below the
    configured threshold, and adaptive execution splits hot keys otherwise.
    """
    return df.join(dim, key)


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a per-key summary back to its rows, after measuring the summary."""
    return df.join(settle(summary), list(keys))


def most_frequent(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values with their counts; ties go to the smaller name."""
    counts = with_keys(df, [key]).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(k)


def semi_topk(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Rows whose key is one of the ``k`` most frequent ones.

    The winners (at most ``k`` values) come back as one array, so the rows are only filtered.
    """
    winners = most_frequent(df, key, k).agg(F.collect_list(key).alias("names"))
    return df.where(F.array_contains(winners.scalar(), F.col(key)))


def align_on_time(
    df: DataFrame,
    keys: Sequence[str],
    measure: str,
    value: str,
    a: str,
    b: str,
) -> DataFrame:
    """Two measures of a long table side by side, per key; incomplete pairs are dropped."""
    sides = df.where(F.col(measure).isin(a, b))
    pairs = with_keys(sides, keys).groupBy(*keys).agg(
        F.avg(F.when(F.col(measure) == a, F.col(value))).alias(a),
        F.avg(F.when(F.col(measure) == b, F.col(value))).alias(b),
    )
    return pairs.dropna(subset=[a, b])
