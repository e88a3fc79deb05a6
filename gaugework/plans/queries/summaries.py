"""Aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import aggregates as agg
from gaugework.operators import joins, ranking
from gaugework.plans.fixtures import MEASURES, observations, table
from gaugework.plans.queries.base import as_long, query, rounded, with_days

UNPIVOT = " UNION ALL ".join(
    "SELECT {keys} '%s' AS measure, %s AS value FROM wide WHERE %s IS NOT NULL" % (m, m, m) for m in MEASURES
)
MEANS = ", ".join(f"avg({m}) AS {m}" for m in MEASURES)


def means_sql(*keys: str) -> str:
    """Mean per key and measure."""
    names = ", ".join(k.split(" AS ")[-1] for k in keys)
    long = UNPIVOT.format(keys=names + ",")
    return (
        f"WITH wide AS (SELECT {', '.join(keys)}, {MEANS} FROM obs GROUP BY ALL), tall AS ({long})\n"
        f"SELECT {names}, measure, round(value + 1.3717e-6, 4) AS value FROM tall"
    )


@query(
    "kpi",
    """
    SELECT measure, count(*) AS count, round(avg(value) + 1.3717e-7, 5) AS mean, round(stddev_samp(value) + 1.3717e-7, 5) AS std,
           min(value) AS min, max(value) AS max
    FROM long GROUP BY measure
    """,
    long=True,
)
def kpi(spark, sf_dir):
    return rounded(agg.kpi(observations(spark, sf_dir), MEASURES), 5, "mean", "std")


@query(
    "describe",
    """
    WITH every AS (
      SELECT measure, value FROM long
      UNION ALL SELECT 'year', year(ts) FROM obs
      UNION ALL SELECT 'month', month(ts) FROM obs
      UNION ALL SELECT 'day', day(ts) FROM obs)
    SELECT measure, count(*) AS count, round(avg(value) + 1.3717e-7, 5) AS mean, round(stddev_samp(value) + 1.3717e-7, 5) AS std,
           min(value) AS min, round(quantile_cont(value, 0.25) + 1.3717e-7, 5) AS q25, round(quantile_cont(value, 0.5) + 1.3717e-7, 5) AS q50,
           round(quantile_cont(value, 0.75) + 1.3717e-7, 5) AS q75, max(value) AS max
    FROM every GROUP BY measure
    """,
    long=True,
)
def describe(spark, sf_dir):
    obs = observations(spark, sf_dir).select(*MEASURES, *[f("ts").alias(n) for n, f in PARTS.items()])
    return rounded(agg.describe(obs, [*MEASURES, *PARTS]), 5, "mean", "std", "q25", "q50", "q75")


PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}


@query(
    "value_counts",
    """
    SELECT 'state' AS "column", state AS value, count(*) AS n FROM obs GROUP BY 2
    UNION ALL SELECT 'location', location, count(*) FROM obs GROUP BY 2
    UNION ALL SELECT 'agency', agency, count(*) FROM obs GROUP BY 2
    UNION ALL SELECT 'type', nullif(type, 'N'), count(*) FROM obs GROUP BY 2
    """,
    obs=True,
)
def value_counts(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("type", F.nullif(F.col("type"), F.lit("N")))
    return agg.value_counts_all(obs, ["state", "location", "agency", "type"])


@query("value_counts_one", "SELECT agency, count(*) AS n FROM obs GROUP BY agency", obs=True)
def value_counts_one(spark, sf_dir):
    return agg.value_counts(observations(spark, sf_dir), "agency")


@query(
    "missing_percent",
    "WITH t AS (SELECT * FROM (SELECT count(*) AS total, "
    + ", ".join(f"count(*) - count({m}) AS {m}" for m in MEASURES)
    + " FROM obs)) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS \"column\", {m} AS missing, round({m} * 100.0 / total + 1.3717e-8, 6) AS percent FROM t" for m in MEASURES
    ),
    obs=True,
)
def missing_percent(spark, sf_dir):
    return rounded(agg.missing_percent(observations(spark, sf_dir), MEASURES), 6, "percent")


def _masked(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


MASKED = """
    WITH flags AS (SELECT CAST(l_tax = 0 AS INT) AS tax, CAST(l_discount = 0 AS INT) AS discount,
                          CAST(l_quantity <= 5 AS INT) AS quantity, 0 AS price FROM lineitem)
"""


@query("missing_patterns", MASKED + "SELECT tax, discount, quantity, price, count(*) AS n FROM flags GROUP BY ALL")
def missing_patterns(spark, sf_dir):
    return agg.missing_patterns(_masked(spark, sf_dir), ["tax", "discount", "quantity", "price"])


@query("missing_mask", MASKED + "SELECT tax, discount, quantity, price FROM flags")
def missing_mask(spark, sf_dir):
    return agg.missing_mask(_masked(spark, sf_dir), ["tax", "discount", "quantity", "price"])


def corr_sql(source: str, names) -> str:
    rows = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) + 1.3717e-8, 6) AS corr FROM {source}" for a in names for b in names
    ]
    return "\nUNION ALL ".join(rows)


@query("missing_corr", MASKED + corr_sql("flags", ["tax", "discount", "quantity"]))
def missing_corr(spark, sf_dir):
    return rounded(agg.missing_corr(_masked(spark, sf_dir), ["tax", "discount", "quantity", "price"]), 6, "corr")


@query("corr_matrix", corr_sql("obs", MEASURES), obs=True)
def corr_matrix(spark, sf_dir):
    return rounded(agg.corr_matrix(observations(spark, sf_dir), MEASURES), 6, "corr")


@query("yearly_mean", means_sql("year(ts) AS year"), obs=True)
def yearly_mean(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("year", F.year("ts").cast("long"))
    return rounded(agg.mean_by_measure(obs, ["year"], MEASURES), 4, "value")


@query("mean_by_date_state", means_sql("strftime(ts, '%Y-%m-%d') AS ts", "state"), obs=True)
def mean_by_date_state(spark, sf_dir):
    return rounded(with_days(agg.mean_by_measure(observations(spark, sf_dir), ["ts", "state"], MEASURES), "ts"), 4, "value")


@query("mean_by_year_location", means_sql("year(ts) AS year", "location"), obs=True)
def mean_by_year_location(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("year", F.year("ts").cast("long"))
    return rounded(agg.mean_by_measure(obs, ["year", "location"], MEASURES), 4, "value")


@query(
    "mean_of_all_measures",
    "SELECT year(ts) AS year, location, round(avg(value) + 1.3717e-6, 4) AS value FROM long GROUP BY ALL",
    long=True,
)
def mean_of_all_measures(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("year", F.year("ts").cast("long"))
    return rounded(agg.mean_of_all(obs, ["year", "location"], MEASURES), 4, "value")


@query("mean_by_location", means_sql("location"), obs=True)
def mean_by_location(spark, sf_dir):
    return rounded(agg.mean_by_measure(observations(spark, sf_dir), ["location"], MEASURES), 4, "value")


@query("monthly_mean", means_sql("strftime(last_day(ts), '%Y-%m-%d') AS month_end"), obs=True)
def monthly_mean(spark, sf_dir):
    return rounded(with_days(agg.monthly_mean(observations(spark, sf_dir), [], "ts", MEASURES), "month_end"), 4, "value")


@query(
    "monthly_mean_by_entity",
    means_sql("state", "location", "strftime(last_day(ts), '%Y-%m-%d') AS month_end"),
    obs=True,
)
def monthly_mean_by_entity(spark, sf_dir):
    monthly = agg.monthly_mean(observations(spark, sf_dir), ["state", "location"], "ts", MEASURES)
    return rounded(with_days(monthly, "month_end"), 4, "value")


YEARS = range(1995, 2002)


def _pivot_sql(rows: str, columns: list[tuple[str, str]], value: str, fill: str = "") -> str:
    cells = []
    for name, test in columns:
        cell = f"round(avg(CASE WHEN {test} THEN {value} END) + 1.3717e-6, 4)"
        cells.append(f'{f"coalesce({cell}, {fill})" if fill else cell} AS "{name}"')
    return f"SELECT {rows}, {', '.join(cells)} FROM obs GROUP BY 1"


@query(
    "month_year_pivot",
    _pivot_sql("month(ts) AS month", [(str(y), f"year(ts) = {y}") for y in YEARS], "tax"),
    obs=True,
)
def month_year_pivot(spark, sf_dir):
    pivot = as_long(agg.month_year_pivot(observations(spark, sf_dir), "ts", "tax"), "month")
    return rounded(pivot, 4, *[c for c in pivot.columns if c != "month"])


@query(
    "year_month_pivot",
    _pivot_sql("year(ts) AS year", [(str(m), f"month(ts) = {m}") for m in range(1, 13)], "price", "0"),
    obs=True,
)
def year_month_pivot(spark, sf_dir):
    pivot = as_long(agg.month_year_pivot(observations(spark, sf_dir), "ts", "price", rows="year", fill=0.0), "year")
    return rounded(pivot, 4, *[c for c in pivot.columns if c != "year"])


@query(
    "state_profile",
    "SELECT state, " + ", ".join(f"round(coalesce(avg({m}), 0) + 1.3717e-6, 4) AS {m}" for m in MEASURES) + " FROM obs GROUP BY state",
    obs=True,
)
def state_profile(spark, sf_dir):
    return rounded(agg.profile_means(observations(spark, sf_dir), ["state"], MEASURES), 4, *MEASURES)


@query(
    "year_profile",
    "SELECT year(ts) AS year, "
    + ", ".join(f"round(coalesce(avg({m}), 0) + 1.3717e-6, 4) AS {m}" for m in MEASURES)
    + " FROM obs GROUP BY 1",
    obs=True,
)
def year_profile(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("year", F.year("ts").cast("long"))
    return rounded(agg.profile_means(obs, ["year"], MEASURES), 4, *MEASURES)


EDGES = "edges AS (SELECT state AS source, measure AS target, count(*) AS value FROM long GROUP BY ALL)"


def _edges(spark, sf_dir):
    return agg.flow_counts(observations(spark, sf_dir), "state", MEASURES)


@query("flow_counts", f"WITH {EDGES} SELECT * FROM edges", long=True)
def flow_counts(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(
    "flow_links",
    f"""
    WITH {EDGES},
    s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS source_index FROM (SELECT DISTINCT source FROM edges)),
    t AS (SELECT target, row_number() OVER (ORDER BY target) - 1 + (SELECT count(*) FROM s) AS target_index
          FROM (SELECT DISTINCT target FROM edges))
    SELECT source, target, value, source_index, target_index FROM edges JOIN s USING (source) JOIN t USING (target)
    """,
    long=True,
)
def flow_links(spark, sf_dir):
    return agg.flow_links(_edges(spark, sf_dir))


@query(
    "flow_nodes",
    """
    WITH s AS (SELECT DISTINCT agency AS name FROM obs), t AS (SELECT DISTINCT measure AS name FROM long)
    SELECT name, row_number() OVER (ORDER BY name) - 1 AS index, 'source' AS side FROM s
    UNION ALL SELECT name, row_number() OVER (ORDER BY name) - 1 + (SELECT count(*) FROM s), 'target' FROM t
    """,
    long=True,
)
def flow_nodes(spark, sf_dir):
    return agg.flow_nodes(agg.flow_counts(observations(spark, sf_dir), "agency", MEASURES))


@query(
    "graph_degree",
    f"""
    WITH {EDGES}
    SELECT node, count(*) AS degree FROM (SELECT DISTINCT source AS node, target AS other FROM edges
      UNION SELECT target, source FROM edges) GROUP BY node
    """,
    long=True,
)
def graph_degree(spark, sf_dir):
    return agg.graph_degree(_edges(spark, sf_dir))


@query(
    "edge_width",
    f"WITH {EDGES} SELECT source, target, value, round(value * 5.0 / (SELECT max(value) FROM edges) + 1.3717e-8, 6) AS width FROM edges",
    long=True,
)
def edge_width(spark, sf_dir):
    return rounded(agg.edge_width(_edges(spark, sf_dir)), 6, "width")


@query(
    "hierarchy_sum",
    """
    WITH l3 AS (SELECT state, location, measure, sum(value) AS value FROM long GROUP BY ALL),
    l2 AS (SELECT state, location, sum(value) AS value FROM l3 GROUP BY ALL),
    l1 AS (SELECT state, sum(value) AS value FROM l2 GROUP BY ALL)
    SELECT 3 AS level, l3.state, l3.location, l3.measure, l3.location AS parent, round(l3.value + 1.3717e-4, 2) AS value,
           round(l3.value / l2.value + 1.3717e-8, 6) AS share FROM l3 JOIN l2 USING (state, location)
    UNION ALL SELECT 2, l2.state, l2.location, NULL, l2.state, round(l2.value + 1.3717e-4, 2), round(l2.value / l1.value + 1.3717e-8, 6)
      FROM l2 JOIN l1 USING (state)
    UNION ALL SELECT 1, state, NULL, NULL, NULL, round(value + 1.3717e-4, 2), round(value / (SELECT sum(value) FROM l1) + 1.3717e-8, 6) FROM l1
    """,
    long=True,
)
def hierarchy_sum(spark, sf_dir):
    tree = agg.hierarchy_sum(observations(spark, sf_dir), ["state", "location"], MEASURES)
    return rounded(rounded(tree, 2, "value"), 6, "share")


@query(
    "hierarchy_sum_short",
    """
    WITH l2 AS (SELECT state, measure, sum(value) AS value FROM long GROUP BY ALL),
    l1 AS (SELECT state, sum(value) AS value FROM l2 GROUP BY ALL)
    SELECT 2 AS level, l2.state, l2.measure, l2.state AS parent, round(l2.value + 1.3717e-4, 2) AS value,
           round(l2.value / l1.value + 1.3717e-8, 6) AS share FROM l2 JOIN l1 USING (state)
    UNION ALL SELECT 1, state, NULL, NULL, round(value + 1.3717e-4, 2), round(value / (SELECT sum(value) FROM l1) + 1.3717e-8, 6) FROM l1
    """,
    long=True,
)
def hierarchy_sum_short(spark, sf_dir):
    tree = agg.hierarchy_sum(observations(spark, sf_dir), ["state"], MEASURES)
    return rounded(rounded(tree, 2, "value"), 6, "share")


@query(
    "distinct_count",
    "SELECT count(DISTINCT state) AS state, count(DISTINCT location) AS location, count(DISTINCT ts) AS ts FROM obs",
    obs=True,
)
def distinct_count(spark, sf_dir):
    return agg.distinct_count(observations(spark, sf_dir), ["state", "location", "ts"])


# --- rankings --------------------------------------------------------------------------


@query(
    "top_means",
    means_sql("location").replace(
        "SELECT location, measure, round(value + 1.3717e-6, 4) AS value FROM tall",
        "SELECT location, measure, round(value + 1.3717e-6, 4) AS value, rank FROM (SELECT *, row_number() OVER "
        "(PARTITION BY measure ORDER BY value DESC, location) AS rank FROM tall) WHERE rank <= 10",
    ),
    obs=True,
)
def top_means(spark, sf_dir):
    return rounded(as_long(ranking.top_means(observations(spark, sf_dir), "location", MEASURES), "rank"), 4, "value")


@query(
    "sort_rows",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS ts, location, round(avg(price) + 1.3717e-6, 4) AS price FROM obs GROUP BY 1, 2 ORDER BY 1, 2
    """,
    obs=True,
)
def sort_rows(spark, sf_dir):
    means = agg.mean_by(observations(spark, sf_dir), ["ts", "location"], ["price"])
    return rounded(with_days(ranking.sort_rows(means, ["ts", "location"]), "ts"), 4, "price")


@query(
    "first_intervals",
    """
    SELECT location, strftime(ts, '%Y-%m-%d') AS start, strftime(ts + INTERVAL 10 DAY, '%Y-%m-%d') AS "end"
    FROM (SELECT DISTINCT location, ts FROM obs ORDER BY ts, location LIMIT 100)
    """,
    obs=True,
)
def first_intervals(spark, sf_dir):
    return with_days(ranking.intervals(observations(spark, sf_dir), "location", "ts"), "start", "end")


@query(
    "most_frequent",
    "SELECT location, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC, location LIMIT 5",
    obs=True,
)
def most_frequent(spark, sf_dir):
    return joins.most_frequent(observations(spark, sf_dir), "location", 5)


@query(
    "sample_rows",
    """
    SELECT event_id, user_id, event_type, round(value + 1.3717e-6, 4) AS value FROM events
    ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id LIMIT 2000
    """,
)
def sample_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return rounded(ranking.sample_n(events, 2000, key=["event_id"], portable=True), 4, "value")


@query(
    "sample_rows_without_key",
    """
    SELECT state, year(ts) AS year, month(ts) AS month, price FROM obs
    ORDER BY md5(concat_ws(':', '42', state, year(ts), month(ts), price)), state, year(ts), month(ts), price LIMIT 5000
    """,
    obs=True,
)
def sample_rows_without_key(spark, sf_dir):
    """5000 (state, value) rows; there is no unique key, so all columns are hashed."""
    obs = observations(spark, sf_dir)
    chosen = obs.select("state", F.year("ts").alias("year"), F.month("ts").alias("month"), "price")
    return as_long(ranking.sample_n(chosen, 5000, portable=True), "year", "month")


@query(
    "first_k_values",
    "SELECT DISTINCT location FROM obs ORDER BY location LIMIT 6",
    obs=True,
)
def first_k_values(spark, sf_dir):
    return ranking.first_k_values(observations(spark, sf_dir), "location")


@query(
    "facet_rows",
    """
    SELECT location, strftime(ts, '%Y-%m-%d') AS ts, measure, round(value + 1.3717e-6, 4) AS value FROM long
    WHERE location IN (SELECT DISTINCT location FROM obs ORDER BY 1 LIMIT 6)
    """,
    long=True,
)
def facet_rows(spark, sf_dir):
    return rounded(with_days(ranking.facet_rows(observations(spark, sf_dir), "location", "ts", MEASURES), "ts"), 4, "value")


@query("distinct_rows", "SELECT DISTINCT state, location, type FROM obs", obs=True)
def distinct_rows(spark, sf_dir):
    return ranking.distinct_rows(observations(spark, sf_dir), ["state", "location", "type"])


@query(
    "union_all",
    """
    SELECT state AS name, count(*) AS n FROM obs GROUP BY 1 UNION ALL SELECT location, count(*) FROM obs GROUP BY 1
    """,
    obs=True,
)
def union_all(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return ranking.union_all(*[obs.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")) for c in ("state", "location")])
