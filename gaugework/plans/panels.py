"""Interactive views: every panel as a table over the selected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import label
from gaugework.operators import aggregates as agg
from gaugework.operators import clustering, filters, joins, ranking, windows
from gaugework.operators.arima import arima_forecast
from gaugework.operators.cleaning import melt
from gaugework.operators.filters import Selection, apply_selection
from gaugework.operators.stl import stl
from gaugework.plans.report import Results
from gaugework.roles import Roles


def choices(wide: DataFrame, roles: Roles) -> Results:
    """What a user can pick from: regions, places and the time range."""
    return {
        "regions": lambda: filters.options(wide, roles.region),
        "places": lambda: filters.options(wide, roles.place),
        "default_regions": lambda: filters.options(wide, roles.region, 3),
        "default_places": lambda: filters.options(wide, roles.place, 5),
        "time_range": lambda: filters.time_bounds(wide, roles.time),
    }


def panels(
    wide: DataFrame,
    roles: Roles,
    selection: Selection | None = None,
    measures: Sequence[str] | None = None,
    pair: tuple[str, str] | None = None,
    places: DataFrame | None = None,
    threshold: float = 3.0,
    steps: int = 12,
    clusters: int = 4,
    by_place: bool = False,
) -> Results:
    """Panel tables by name, for the rows of ``selection``; each is planned when it is called.

    Selections are predicates on the given table, so they reach its scan. Series are
    analysed for all places at once; pick one with ``filter_eq``.
    """
    roles.require(wide.columns)
    rows = apply_selection(wide, selection) if selection else wide
    measures = list(measures or roles.measures)
    a, b = pair or (measures[0], measures[1])
    time, region, place = roles.time, roles.region, roles.place
    entity = place if by_place else region
    dated = rows.withColumn("year", F.year(time))

    def long():
        return melt(rows, [place, time], measures)

    def clustered():
        return clustering.kmeans(clustering.feature_matrix(rows, [entity], time, measures), [entity], k=clusters)

    results: Results = {
        "profile": lambda: agg.profile_schema(rows),
        "preview": lambda: agg.preview(rows, [time, place]),
        "describe": lambda: agg.describe(rows, measures),
        "kpi": lambda: agg.kpi(rows, measures).withColumn("label", label("measure")),
        "trends": lambda: ranking.sort_rows(long(), [time, place, "measure"]),
        "rolling_trends": lambda: windows.rolling_mean_time(long(), [place, "measure"], time, "value", 30),
        "compare": lambda: ranking.facet_rows(rows, place, time, measures),
        "heatmap": lambda: agg.month_year_pivot(rows, time, measures[0]),
        "top_places": lambda: ranking.top_means(rows, place, measures, 10),
        "rolling_correlation": lambda: windows.rolling_corr(rows, [place], time, a, b),
        "last_month": lambda: melt(filters.last_period(rows, time, 1, "month"), [place, time], measures),
        "last_half_year": lambda: melt(filters.last_period(rows, time, 6, "months"), [place, time], measures),
        "last_year": lambda: melt(filters.last_period(rows, time, 1, "year"), [place, time], measures),
        "spikes": lambda: windows.zscore_spikes(long(), [place, "measure"], "value", threshold),
        "decomposition": lambda: stl(rows, [place], time, measures),
        "forecast": lambda: arima_forecast(rows, [place], time, measures, steps),
        "cluster_trends": lambda: clustering.cluster_trends(clustered()),
        "cluster_members": lambda: clustering.cluster_assignments(clustered(), [entity]),
        "export": lambda: rows,
    }
    if places is not None:
        results["map"] = lambda: joins.lookup(agg.mean_by_measure(dated, ["year", place], measures), places, place)
    return results
