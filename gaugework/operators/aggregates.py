"""Summaries: KPIs, counts, correlations, means by group, pivots, flows and hierarchies.

Wide tables are aggregated over all measures in one pass and only the small
result is turned long, instead of multiplying the rows first.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.safe import nan_to_null, pair_corr, ratio, with_keys
from gaugework.functions.temporal import month_end
from gaugework.operators.cleaning import melt
from gaugework.operators.joins import one_row
from gaugework.operators.quantiles import quantiles
from gaugework.session import number_rows, settle


def _stack(df: DataFrame, keys: Sequence[str], rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn one wide row per key into one output row per entry of ``rows``."""
    entries = F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])
    return df.select(*keys, F.inline(entries))


# --- whole-table summaries -------------------------------------------------------------


def kpi(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """count, mean, std, min and max of every measure, in one pass."""
    aggs = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    values = {m: nan_to_null(F.col(m).cast("double")) for m in measures}
    wide = df.agg(*[f(values[m]).alias(f"{m}_{name}") for m in measures for name, f in aggs.items()])
    rows = [{"measure": F.lit(m)} | {name: F.col(f"{m}_{name}") for name in aggs} for m in measures]
    return _stack(wide, [], rows)


def describe(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation) and max of numeric columns.

    The moments are taken in the pass of the quartiles' sketch.
    """
    moments = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = quantiles(df, columns, (0.25, 0.5, 0.75), approximate=approximate, also=moments)
    quartiles = [F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return found.select("measure", F.col("n").alias("count"), "mean", "std", "min", *quartiles, "max")


def profile_schema(df: DataFrame) -> DataFrame:
    """Column, type, non-null count and row count."""
    total = df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"n_{c}") for c in df.columns])
    rows = [
        {"column": F.lit(c), "dtype": F.lit(t), "non_null": F.col(f"n_{c}"), "total": F.col("total")}
        for c, t in df.dtypes
    ]
    return _stack(total, [], rows)


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Frequency of every value, most frequent first; nulls form a bucket of their own."""
    rows = df if keep_null else with_keys(df, [column])
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def value_counts_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequencies of several columns in one pass, as (column, value, n); nulls included."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    pairs = df.select(F.inline(F.array(*cells)))
    return pairs.groupBy("column", "value").agg(F.count("*").alias("n")).orderBy("column", F.desc("n"), "value")


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values per column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns])


# --- missing data ----------------------------------------------------------------------


def _missing(df: DataFrame, column: str) -> Column:
    numeric = dict(df.dtypes)[column] in ("double", "float")
    return (nan_to_null(column) if numeric else F.col(column)).isNull()


def missing_percent(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column, worst first."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(_missing(df, c)).alias(c) for c in columns])
    rows = [
        {"column": F.lit(c), "missing": F.col(c), "percent": ratio(F.col(c) * 100.0, F.col("total"))} for c in columns
    ]
    return _stack(wide, [], rows).orderBy(F.desc("percent"), "column")


def missing_mask(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One 0/1 flag per column and row."""
    return df.select(*keys, *[_missing(df, c).cast("int").alias(c) for c in columns])


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows share each combination of missing columns."""
    return missing_mask(df, columns).groupBy(*columns).agg(F.count("*").alias("n"))


def missing_corr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of the null flags; columns that are never or always null are left out."""
    return corr_matrix(missing_mask(df, columns), columns).where(F.col("corr").isNotNull())


def corr_matrix(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of all measures, as rows (a, b, corr).

    All pairs come from one aggregate; each unordered pair is computed once.
    """
    measures = list(measures)
    values = {m: nan_to_null(F.col(m).cast("double")) for m in measures}
    pairs = [*combinations(measures, 2), *[(m, m) for m in measures]]
    aggs = [pair_corr(values[a], values[b]).alias(f"{a}|{b}") for a, b in pairs]
    wide = df.agg(*aggs)
    both_ways = pairs + [(b, a) for a, b in pairs if a != b]
    rows = [
        {"a": F.lit(a), "b": F.lit(b), "corr": F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`")}
        for a, b in both_ways
    ]
    return _stack(wide, [], rows)


# --- means by group --------------------------------------------------------------------


def mean_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean of every measure per key, wide; rows with a null key are left out."""
    values = [F.avg(nan_to_null(F.col(m).cast("double"))).alias(m) for m in measures]
    return with_keys(df, keys).groupBy(*keys).agg(*values)


def mean_by_measure(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Same as ``mean_by`` in long form: aggregate wide first, then one row per measure."""
    return melt(mean_by(df, keys, measures), keys, measures)


def mean_of_all(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One mean per key over the values of all measures together."""
    values = [nan_to_null(F.col(m).cast("double")) for m in measures]
    total = sum((F.coalesce(F.sum(v), F.lit(0.0)) for v in values), F.lit(0.0))
    count = sum((F.count(v) for v in values), F.lit(0))
    grouped = with_keys(df, keys).groupBy(*keys).agg(ratio(total, count).alias("value"))
    return grouped.where(F.col("value").isNotNull())


def monthly_mean(df: DataFrame, keys: Sequence[str], time: str, measures: Sequence[str]) -> DataFrame:
    """Mean per key and calendar month, labelled by the month's last day; empty months do not appear."""
    dated = df.withColumn("month_end", month_end(time))
    return mean_by_measure(dated, [*keys, "month_end"], measures)


# --- pivots ----------------------------------------------------------------------------


def pivot_mean(
    df: DataFrame,
    rows: Sequence[str],
    column: str,
    value: str,
    values: Sequence | None = None,
    fill: float | None = None,
) -> DataFrame:
    """Two-way table of means. The rows are reduced per cell before the cells become columns.

    Cells without a value are left out, so a row or column of such cells does not appear.
    Without given ``values`` the columns are found from the kept cells, as many as
    spark.sql.pivotMaxValues allows.
    """
    cells = with_keys(mean_by(df, [*rows, column], [value]), [column]).where(F.col(value).isNotNull())
    cells = settle(cells) if values is None else cells
    grouped = cells.groupBy(*rows)
    table = (grouped.pivot(column) if values is None else grouped.pivot(column, list(values))).agg(F.first(value))
    return table if fill is None else table.fillna(fill)


def month_year_pivot(
    df: DataFrame,
    time: str,
    measure: str,
    rows: str = "month",
    fill: float | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Month × year means: ``rows="month"`` puts years in the columns, ``rows="year"`` months."""
    dated = df.select(F.year(time).alias("year"), F.month(time).alias("month"), measure)
    if rows == "month":
        return pivot_mean(dated, ["month"], "year", measure, years, fill)
    return pivot_mean(dated, ["year"], "month", measure, list(range(1, 13)), fill)


def profile_means(df: DataFrame, keys: Sequence[str], measures: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Key × measure table of means, missing cells filled."""
    return mean_by(df, keys, measures).fillna(fill, subset=list(measures))


# --- flows, graphs and hierarchies -----------------------------------------------------


def flow_counts(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Number of present values per (key, measure): the edges of a two-sided flow."""
    counts = [F.count(nan_to_null(F.col(m).cast("double"))).alias(m) for m in measures]
    wide = with_keys(df, [key]).groupBy(key).agg(*counts)
    edges = melt(wide, [key], measures, "target", "value", "long").where(F.col("value") > 0)
    return edges.withColumnRenamed(key, "source")


def rank_names(names: DataFrame, column: str) -> DataFrame:
    """Zero-based position of every distinct name in sorted order.

    The names are range-partitioned and numbered inside their partition (``number_rows``),
    so no task sorts more than its share, however alike the names begin.
    """
    distinct = with_keys(names, [column]).select(column).distinct()
    return number_rows(distinct, [column], "index").select(column, F.col("index").cast("long").alias("index"))


def flow_nodes(edges: DataFrame) -> DataFrame:
    """Node list: sources first, then targets, each in sorted order."""
    edges = settle(edges)
    left = rank_names(edges, "source").select(F.col("source").alias("name"), "index", F.lit("source").alias("side"))
    right = rank_names(edges, "target").select(F.col("target").alias("name"), "index", F.lit("target").alias("side"))
    shift = one_row(edges.agg(F.count_distinct("source").alias("sources")))["sources"]
    return left.unionByName(right.withColumn("index", F.col("index") + shift))


def flow_links(edges: DataFrame) -> DataFrame:
    """Edges with the node positions of both ends."""
    edges = settle(edges)
    nodes = settle(flow_nodes(edges))
    sources = nodes.where("side = 'source'").select(F.col("name").alias("source"), F.col("index").alias("source_index"))
    targets = nodes.where("side = 'target'").select(F.col("name").alias("target"), F.col("index").alias("target_index"))
    return edges.join(sources, "source").join(targets, "target")


def graph_degree(edges: DataFrame) -> DataFrame:
    """Number of distinct neighbours of every node."""
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("other"))
    )
    return ends.distinct().groupBy("node").agg(F.count("*").alias("degree"))


def edge_width(edges: DataFrame, widest: float = 5.0) -> DataFrame:
    """Line width proportional to the edge value, the largest being ``widest``."""
    top = one_row(edges.agg(F.max("value").alias("top")))["top"]
    return edges.withColumn("width", ratio(F.col("value").cast("double"), top) * widest)


def hierarchy_sum(df: DataFrame, path: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum at every level of ``path`` + measure, with parent and share of the parent.

    The rows are reduced to the leaves once; nodes, parents and the grand total are all
    summed from that settled table.
    Output: level, the path columns, measure (null above its level), parent, value, share.
    """
    path = list(path)
    sums = [F.sum(nan_to_null(F.col(m).cast("double"))).alias(m) for m in measures]
    leaves = with_keys(df, path).groupBy(*path).agg(*sums)
    leaves = settle(melt(leaves, path, measures, value_name="leaf"))
    levels = [*path, "measure"]
    rolled = leaves.rollup(*levels).agg(F.sum("leaf").alias("value"), F.grouping_id().alias("gid"))
    # grouping_id is 0 at the deepest level and 2^k - 1 when the last k levels are rolled up.
    depth = sum((F.when(F.col("gid") == 2**k - 1, len(levels) - k).otherwise(0) for k in range(len(levels))), F.lit(0))
    tree = rolled.withColumn("level", depth).where(F.col("level") > 0).drop("gid")
    names = F.array(*[F.col(c).cast("string") for c in levels])
    tree = tree.withColumns(
        {
            "node": F.slice(names, 1, F.col("level")),
            "above": F.slice(names, 1, F.col("level") - 1),
        }
    )
    totals = tree.select(F.col("node").alias("above"), F.col("value").alias("parent_value"))
    grand = one_row(leaves.agg(F.sum("leaf").alias("total")))["total"]
    out = tree.join(totals, "above", "left")
    share = ratio(F.col("value"), F.coalesce("parent_value", grand))
    parent = F.when(F.col("level") > 1, F.element_at("above", -1))
    return out.select("level", *levels, parent.alias("parent"), "value", share.alias("share"))
