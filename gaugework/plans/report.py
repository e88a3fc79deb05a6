"""The whole exploratory report: every numbered result as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.safe import with_keys
from gaugework.operators import aggregates as agg
from gaugework.operators import clustering, joins, ranking, text, windows
from gaugework.operators import distributions as dist
from gaugework.operators.cleaning import melt
from gaugework.operators.stl import stl
from gaugework.operators.ward import ward_linkage
from gaugework.roles import Roles
from gaugework.sources import write_csv

Results = dict[str, Callable[[], DataFrame]]


def batch_report(wide: DataFrame, roles: Roles, raw: DataFrame | None = None, places: DataFrame | None = None) -> Results:
    """Results by name; each is planned only when it is called.

    ``wide`` is the cleaned table (persist it when several results are wanted) and
    ``raw`` the table before imputation, for the missing-data results. ``places``
    holds a coordinate per place; without it there is no map.
    """
    roles.require(wide.columns)
    measures, time, region, place = list(roles.measures), roles.time, roles.region, roles.place
    source = raw if raw is not None else wide
    dated = wide.withColumns({"year": F.year(time), "month": F.month(time), "day": F.dayofmonth(time)})
    named = [c for c in roles.dims if c in wide.columns]

    def edges():
        return agg.flow_counts(wide, region, measures)

    def top_places():
        return joins.semi_topk(wide, place, 5)

    def rolling_averages():
        daily = windows.daily_mean(top_places(), [place], time, measures[-1])
        return windows.rolling_mean_rows(windows.complete_days(daily, [place]), [place], "day")

    def spikes():
        long = melt(with_keys(wide, [place, time]), [place, time], measures)
        return windows.zscore_spikes(long, [place, "measure"], "value")

    def trends():
        matrix = clustering.feature_matrix(wide, [region], time, measures)
        return clustering.cluster_trends(clustering.kmeans(matrix, [region], k=5))

    results: Results = {
        "descriptive_statistics": lambda: agg.describe(dated, [*measures, "year", "month", "day"]),
        "value_counts": lambda: agg.value_counts_all(wide, named),
        "missing_percent": lambda: agg.missing_percent(source, measures),
        "missing_matrix": lambda: agg.missing_patterns(source, measures),
        "missing_correlation": lambda: agg.missing_corr(source, measures),
        "univariate_histograms": lambda: dist.histogram(wide, measures, 50),
        "univariate_densities": lambda: dist.kde(wide, measures, scale="count", bins=50),
        "univariate_boxes": lambda: dist.box_stats(wide, measures),
        "correlation_matrix": lambda: agg.corr_matrix(wide, measures),
        "yearly_trend": lambda: agg.mean_by(dated, ["year"], measures),
        "flow_links": lambda: agg.flow_links(edges()),
        "flow_nodes": lambda: agg.flow_nodes(edges()),
        "network_edges": lambda: agg.edge_width(edges()),
        "network_degrees": lambda: agg.graph_degree(edges()),
        "region_profile": lambda: agg.profile_means(wide, [region], measures),
        "dendrogram": lambda: ward_linkage(agg.profile_means(wide, [region], measures), region, measures),
        "ridgeline": lambda: dist.kde(wide, measures, [region], grid="shared", pad=0.2, points=1000),
        "sunburst": lambda: agg.hierarchy_sum(wide, [region, place], measures),
        "treemap": lambda: agg.hierarchy_sum(wide, [region], measures),
        "parallel_coordinates": lambda: ranking.sample_n(
            dated.select("year", "month", F.col(measures[0]).alias("value")).dropna(), 2000
        ),
        "intervals": lambda: ranking.intervals(wide, place, time),
        "trellis": lambda: dist.histogram(wide, measures, 30, [region]),
        "trellis_densities": lambda: dist.kde(wide, measures, [region], scale="count", bins=30),
        "violins": lambda: dist.kde(wide, measures, [region], cut=2.0, points=100),
        "swarm": lambda: ranking.sample_n(wide.select(region, F.col(measures[0]).alias("value")).dropna(), 5000),
        "hexbin": lambda: dist.hexbin(wide, measures[0], measures[1]),
        "stacked_years": lambda: agg.profile_means(dated, ["year"], measures),
        "word_frequencies": lambda: text.phrase_counts(wide, roles.text or place),
        "region_series": lambda: agg.mean_by_measure(wide, [time, region], measures),
        "rolling_averages": rolling_averages,
        "decomposition": lambda: stl(wide, [region], time, measures, gaps="fill"),
        "month_year": lambda: agg.month_year_pivot(wide, time, measures[0], rows="year", fill=0.0),
        "facets": lambda: dist.mean_ci_by(
            melt(with_keys(top_places(), [place, time]), [place, time], measures), [place, "measure", time], "value"
        ),
        "place_years": lambda: agg.mean_of_all(joins.semi_topk(dated, place, 5), ["year", place], measures),
        "rolling_correlation": lambda: windows.rolling_corr(wide, [region], time, measures[0], measures[1], grain="day"),
        "place_series": lambda: agg.mean_by_measure(wide, [time, place], measures),
        "spikes": spikes,
        "cluster_trends": trends,
    }
    if places is not None:
        results["map_intensity"] = lambda: dist.grid_intensity(wide, places, place, measures[0])
        results["map_years"] = lambda: joins.lookup(agg.mean_by_measure(dated, ["year", place], measures), places, place)
    return results


def write_report(results: Results, folder: str, names: Iterable[str] | None = None) -> list[str]:
    """Write the results as headered CSV, one folder each; gives the written paths."""
    written = []
    for name in names or results:
        path = f"{folder.rstrip('/')}/{name}"
        write_csv(_flat(results[name]()), path)
        written.append(path)
    return written


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no arrays: they are written as JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
