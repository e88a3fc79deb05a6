"""Top-k, sampling, first-n and distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.safe import with_keys
from gaugework.operators.aggregates import mean_by_measure
from gaugework.operators.cleaning import add_interval, melt
from gaugework.operators.filters import filter_in
from gaugework.operators.joins import one_row


def top_means(df: DataFrame, key: str, measures: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` keys with the highest mean, for every measure at once; ties go to the smaller name.

    Spark limits each partition to ``k`` rows per measure before the shuffle, because
    the rank is filtered directly.
    """
    means = mean_by_measure(df, [key], measures)
    order = Window.partitionBy("measure").orderBy(F.desc("value"), key)
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sort_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.orderBy(*columns)


def first_n_distinct(df: DataFrame, columns: Sequence[str], order: Sequence[str], n: int = 100) -> DataFrame:
    """Distinct non-null combinations, the first ``n`` in the given order."""
    return with_keys(df, columns).select(*columns).distinct().orderBy(*order).limit(n)


def intervals(df: DataFrame, key: str, time: str, n: int = 100, days: int = 10) -> DataFrame:
    """Bars of a fixed length for the first ``n`` distinct (key, time) pairs."""
    return add_interval(first_n_distinct(df, [key, time], [time, key], n), time, days).drop(time)


def sample_n(
    df: DataFrame,
    n: int,
    seed: int = 42,
    key: Sequence[str] | None = None,
    portable: bool = False,
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, the same ones on every run.

    Rows are ordered by a seeded hash of ``key`` (all columns when there is no
    unique key), so the choice does not depend on how the data is partitioned.
    ``portable`` uses MD5, which other engines can repeat.

    A first pass counts the rows per leading 16 bits of the hash and finds how far the
    smallest ``n`` reach; only the rows up to there are sorted. Equal rows are merged
    before that, so many copies of one row cost no more than one.
    """
    columns = [F.col(c) for c in (key or df.columns)]
    if portable:
        draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))
        lead = F.conv(F.substring(draw, 1, 4), 16, 10).cast("int")
    else:
        draw = F.xxhash64(F.lit(seed), *columns)
        lead = F.shiftright(draw, 48).cast("int")
    counts = df.groupBy(lead.alias("lead")).agg(F.count("*").alias("rows"))
    # At most 65,536 rows are sorted in this task.
    through = F.sum("rows").over(Window.orderBy("lead"))
    reach = counts.withColumn("through", through).where(F.col("through") - F.col("rows") < n)
    near = df.where(lead <= reach.agg(F.max("lead").alias("lead")).scalar())
    merged = near.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    first = merged.orderBy(draw, *columns).limit(n)
    # From here on there are at most n rows.
    before = F.sum("_copies").over(Window.orderBy(draw, *columns)) - F.col("_copies")
    taken = first.withColumn("_taken", F.least(F.col("_copies"), n - before)).where("_taken > 0")
    repeated = F.explode(F.sequence(F.lit(1), F.col("_taken").cast("int")))
    return taken.select(*df.columns, repeated.alias("_copy")).drop("_copy")


def first_k_values(df: DataFrame, column: str, k: int = 6) -> DataFrame:
    """The first ``k`` distinct values in sorted order."""
    return with_keys(df, [column]).select(column).distinct().orderBy(column).limit(k)


def facet_rows(
    df: DataFrame,
    key: str,
    time: str,
    measures: Sequence[str],
    chosen: Sequence[str] | None = None,
    k: int = 6,
) -> DataFrame:
    """Long rows for all chosen keys (by default the first ``k`` in order), complete ones only."""
    if chosen is None:
        names = one_row(first_k_values(df, key, k).agg(F.collect_list(key).alias("names")))["names"]
        kept = df.where(F.array_contains(names, F.col(key)))
    else:
        kept = filter_in(df, key, list(chosen))
    return melt(with_keys(kept, [key, time]), [key, time], measures)


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack results by column name, keeping duplicates."""
    for other in others:
        first = first.unionByName(other)
    return first
