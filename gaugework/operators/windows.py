"""Rolling statistics, gap filling, calendars and spike detection over every series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.safe import nan_to_null, pair_corr, ratio, window_by, with_keys
from gaugework.functions.temporal import month_end, wall_micros
from gaugework.operators.joins import attach, one_row

DAY_MICROS = 86_400_000_000
# A slice's sum is taken over the slices of one window, so more of them split a hot series
# further but cost more additions.
SLICES_PER_DAY = 4


def rolling_mean_time(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    days: int = 30,
    slices: int | None = None,
    per_row: bool = False,
) -> DataFrame:
    """Mean over the wall-clock window ``(t - days, t]`` at every distinct time of each series.

    Rows with the same time are peers and share one result; ``per_row=True`` joins it
    back to every row. A row without a value asks for its window too: it gets the mean of
    the values in there, and null where there are none.

    A series may be far too long for one task, so its timeline is cut into slices of
    ``days / slices``. A window then is the tail of the slice it starts in, the whole
    slices between, and the head of its own slice: tails and heads are running sums
    inside one slice, and the middle is a running sum over slice totals.
    """
    slices = slices or days * SLICES_PER_DAY
    width = days * DAY_MICROS
    if width % slices:
        raise ValueError("the window must divide evenly into slices")
    grain, keys = width // slices, list(keys)
    clean = nan_to_null(F.col(value).cast("double"))
    rows = with_keys(df, [*keys, time]).select(*keys, F.col(time).alias("at"), clean.alias("v"))
    if not per_row:
        rows = rows.where(F.col("v").isNotNull())
    # A time without values is a point that adds nothing to any window and only asks for its own.
    points = rows.groupBy(*keys, "at").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.count("v").alias("c"))
    points = points.withColumn("us", wall_micros("at"))

    # A point enters the window at its time and leaves it exactly ``width`` later: seen
    # from there it is tail. Both rows come from one list, so that the aggregate above is
    # shared by all its uses.
    enters = F.struct(F.col("us").alias("us"), F.lit(True).alias("own"))
    leaves = F.struct((F.col("us") + width).alias("us"), F.lit(False).alias("own"))
    moves = points.select(*keys, "at", "s", "c", F.inline(F.array(enters, leaves)))
    moves = moves.withColumn("slice", F.floor(F.col("us") / grain).cast("long"))
    in_slice = Window.partitionBy(*keys, "slice")
    head = in_slice.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    # What comes later, as a growing frame from the end: a frame that shrinks towards the
    # end would be summed anew for every row.
    tail = in_slice.orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, -1)

    def side(is_own: bool, column: str) -> Column:
        return F.sum(F.when(F.col("own") == is_own, F.col(column)).otherwise(0))

    edges = moves.withColumns(
        {
            "s_edge": side(True, "s").over(head) + F.coalesce(side(False, "s").over(tail), F.lit(0.0)),
            "c_edge": side(True, "c").over(head) + F.coalesce(side(False, "c").over(tail), F.lit(0)),
        }
    )
    edges = edges.where("own")

    totals = moves.where("own").groupBy(*keys, "slice").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    between = Window.partitionBy(*keys).orderBy("slice").rangeBetween(-(slices - 1), -1)
    middle = totals.select(
        *keys,
        "slice",
        F.coalesce(F.sum("s").over(between), F.lit(0.0)).alias("s_mid"),
        F.coalesce(F.sum("c").over(between), F.lit(0)).alias("c_mid"),
    )
    joined = edges.join(middle, [*keys, "slice"])
    mean = ratio(F.col("s_edge") + F.col("s_mid"), F.col("c_edge") + F.col("c_mid"))
    result = joined.select(
        *keys, F.col("at").alias(time), (F.col("c_edge") + F.col("c_mid")).alias("points"), mean.alias("rolling_mean")
    )
    if not per_row:
        return result
    return df.join(result, [*keys, time], "left")


def daily_mean(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Mean per key and calendar day (column ``day``)."""
    clean = nan_to_null(F.col(value).cast("double"))
    dated = with_keys(df, [*keys, time]).withColumn("day", F.to_date(time))
    means = dated.groupBy(*keys, "day").agg(F.avg(clean).alias("value"))
    return means.where(F.col("value").isNotNull())


def rolling_mean_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str = "value",
    sizes: Sequence[int] = (7, 30),
) -> DataFrame:
    """Mean of the last ``size`` rows of each series, fewer at its start.

    Meant for one row per key and time (after ``daily_mean``), so that a series is as
    long as its calendar, however many raw rows it had.
    """
    by = window_by(keys, order)
    return df.withColumns({f"mean_{n}": F.avg(value).over(by.rowsBetween(-(n - 1), 0)) for n in sizes})


def fill_both_ways(df: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Gaps take the previous value of their series; leading gaps the first one."""
    latest = F.last(value, ignorenulls=True)
    before = latest.over(window_by(keys, F.asc(order)).rowsBetween(Window.unboundedPreceding, 0))
    # The next value is the latest one when read backwards; both frames only grow.
    after = latest.over(window_by(keys, F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(value, F.coalesce(before, after))


def month_spine(
    monthly: DataFrame,
    keys: Sequence[str],
    month: str = "month_end",
) -> DataFrame:
    """Every month end between the first and the last month of each series."""
    spans = monthly.groupBy(*keys).agg(F.min(month).alias("first"), F.max(month).alias("last"))
    starts = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("INTERVAL 1 MONTH"))
    return spans.select(*keys, F.explode(starts).alias("start")).select(*keys, month_end("start").alias(month))


def complete_months(
    monthly: DataFrame,
    keys: Sequence[str],
    month: str = "month_end",
    value: str = "value",
    fill: bool = True,
) -> DataFrame:
    """Monthly series on a regular calendar; missing months are filled both ways or left null."""
    spine = month_spine(monthly, keys, month)
    full = spine.join(monthly.select(*keys, month, value), [*keys, month], "left")
    return fill_both_ways(full, keys, month, value) if fill else full


def complete_days(
    daily: DataFrame,
    keys: Sequence[str],
    day: str = "day",
    value: str = "value",
    fill: bool = True,
) -> DataFrame:
    """Every series on all days that any series has, filled both ways or left null.

    The list of days (one per calendar day at most) comes back as one array.
    """
    days = one_row(daily.agg(F.collect_set(day).alias("days")))["days"]
    spine = daily.select(*keys).distinct().withColumn("days", days)
    spine = spine.select(*keys, F.explode("days").alias(day))
    full = spine.join(daily.select(*keys, day, value), [*keys, day], "left")
    return fill_both_ways(full, keys, day, value) if fill else full


def rolling_corr(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    a: str,
    b: str,
    grain: str = "month",
    window: int = 30,
    min_pairs: int = 10,
    more_than: int = 30,
) -> DataFrame:
    """Correlation of two measures over the last ``window`` complete pairs of each series.

    The measures are averaged per month (or per day with ``grain="day"``), so a series is
    as long as its calendar. Series with at most ``more_than`` pairs are left out, and the
    first ``min_pairs - 1`` positions of a series are null.
    """
    if grain == "month":
        at, moment = "month_end", month_end(time)
    elif grain == "day":
        at, moment = "day", F.to_date(time)
    else:
        raise ValueError(f"unknown grain {grain!r}")
    values = [F.avg(nan_to_null(F.col(m).cast("double"))).alias(m) for m in (a, b)]
    pairs = with_keys(df, [*keys, time]).groupBy(*keys, moment.alias(at)).agg(*values).dropna(subset=[a, b])
    # From here on a series has one row per month or day.
    pairs = pairs.withColumn("pairs", F.count("*").over(Window.partitionBy(*keys))).where(F.col("pairs") > more_than)
    last = window_by(keys, at).rowsBetween(-(window - 1), 0)
    enough = F.count("*").over(last) >= min_pairs
    corr = F.when(enough, pair_corr(a, b, last))
    return pairs.select(*keys, at, a, b, corr.alias("rolling_corr"))


def zscore_spikes(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    threshold: float = 3.0,
) -> DataFrame:
    """Adds ``zscore`` and ``is_spike`` within each series; series without spread have no spikes.

    Mean and deviation are aggregated per series and joined back, so that a long
    series is never gathered in one task.
    """
    clean = nan_to_null(F.col(value).cast("double"))
    rows = with_keys(df, keys).where(clean.isNotNull())
    stats = rows.groupBy(*keys).agg(F.avg(clean).alias("mean"), F.stddev_samp(clean).alias("std"))
    z = ratio(F.col(value) - F.col("mean"), F.col("std"))
    scored = attach(rows, stats, keys).withColumn("zscore", z)
    return scored.withColumn("is_spike", F.coalesce(F.abs("zscore") > threshold, F.lit(False))).drop("mean", "std")


def series_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per series."""
    return with_keys(df, keys).groupBy(*keys).agg(F.count("*").alias("points"))
