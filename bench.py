"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Every query runs BENCH_RUNS times after a warm-up, with nothing kept between the runs; the
median counts. Results go to the no-op sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gaugework.plans.queries import QUERIES  # noqa: E402
from gaugework.session import local_session  # noqa: E402

HEADLINE = (
    "read_clean_csv", "impute_mean", "melt", "kpi", "describe", "value_counts", "corr_matrix", "missing_patterns",
    "yearly_mean", "mean_by_date_state", "monthly_mean_by_entity", "month_year_pivot", "top_means", "flow_links",
    "hierarchy_sum", "histogram", "histogram_by_state", "box_stats", "kde_shared_grid", "hexbin", "mean_ci_normal",
    "grid_intensity", "rolling_mean_time", "rolling_mean_time_places", "rolling_mean_rows", "fill_both_ways",
    "rolling_corr_months", "rolling_corr_dates", "zscore_spikes", "sample_rows", "facet_rows", "token_counts",
    "collocations", "feature_matrix", "stl_decomposition", "arima_forecast", "kmeans_states", "ward_linkage",
)


def once(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    spark.catalog.clearCache()
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        once(spark, sf_dir, name)
        times[name] = round(statistics.median(once(spark, sf_dir, name) for _ in range(runs)), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
