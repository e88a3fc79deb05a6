"""Window functions, series models and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.functions.safe import ratio
from gaugework.operators import aggregates as agg
from gaugework.operators import clustering, windows
from gaugework.operators.arima import arima_forecast
from gaugework.operators.joins import semi_topk
from gaugework.operators.stl import stl
from gaugework.operators.ward import ward_linkage
from gaugework.plans.fixtures import MEASURES, observations, table
from gaugework.plans.queries.base import query, rounded, with_days

THIRTY_DAYS = "INTERVAL '29 days 23:59:59.999999' PRECEDING"


@query(
    "rolling_mean_time",
    f"""
    SELECT event_id, user_id, event_type, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts
      RANGE BETWEEN {THIRTY_DAYS.replace("29", "6")} AND CURRENT ROW) + 1.3717e-6, 4) AS rolling_mean
    FROM events
    """,
)
def rolling_mean_time(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    rolled = windows.rolling_mean_time(events, ["user_id", "event_type"], "ts", "value", days=7, per_row=True)
    return rounded(rolled.select("event_id", "user_id", "event_type", "rolling_mean"), 4, "rolling_mean")


@query(
    "rolling_mean_time_places",
    f"""
    WITH r AS (SELECT location, ts, avg(tax) OVER w AS rolling_mean, count(tax) OVER w AS points FROM obs
               WHERE tax IS NOT NULL
               WINDOW w AS (PARTITION BY location ORDER BY ts RANGE BETWEEN {THIRTY_DAYS} AND CURRENT ROW))
    SELECT DISTINCT location, strftime(ts, '%Y-%m-%d') AS ts, points, round(rolling_mean + 1.3717e-8, 6) AS rolling_mean FROM r
    """,
    obs=True,
)
def rolling_mean_time_places(spark, sf_dir):
    rolled = windows.rolling_mean_time(observations(spark, sf_dir), ["location"], "ts", "tax")
    return rounded(with_days(rolled, "ts"), 6, "rolling_mean")


@query(
    "rolling_mean_per_row",
    f"""
    SELECT state, agency, strftime(ts, '%Y-%m-%d') AS ts, quantity, tax, count(tax) OVER w AS points,
           round(avg(tax) OVER w + 1.3717e-8, 6) AS rolling_mean
    FROM obs WINDOW w AS (PARTITION BY state, agency ORDER BY ts RANGE BETWEEN {THIRTY_DAYS} AND CURRENT ROW)
    """,
    obs=True,
)
def rolling_mean_per_row(spark, sf_dir):
    """Every row with its window's mean; rows without a tax get that of the values before them."""
    rows = observations(spark, sf_dir).select("state", "agency", "ts", "quantity", "tax")
    rolled = windows.rolling_mean_time(rows, ["state", "agency"], "ts", "tax", per_row=True)
    return rounded(with_days(rolled, "ts"), 6, "rolling_mean")


# Tax, without the months that every series lacks here: a gap to fill.
GAPPED = "gapped AS (SELECT * FROM obs WHERE month(ts) NOT IN (2, 5, 6) AND tax IS NOT NULL)"


def _gapped(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("tax", F.when(~F.month("ts").isin(2, 5, 6), F.col("tax")))


@query(
    "rolling_mean_rows",
    """
    WITH top AS (SELECT location FROM obs GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 5),
    daily AS (SELECT location, CAST(ts AS DATE) AS day, avg(tax) AS value FROM obs JOIN top USING (location)
              WHERE tax IS NOT NULL GROUP BY ALL),
    spine AS (SELECT location, day FROM (SELECT DISTINCT location FROM daily), (SELECT DISTINCT day FROM daily)),
    f AS (SELECT s.location, s.day, coalesce(
            last_value(value IGNORE NULLS) OVER (PARTITION BY s.location ORDER BY s.day
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(value IGNORE NULLS) OVER (PARTITION BY s.location ORDER BY s.day
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
          FROM spine s LEFT JOIN daily d ON s.location = d.location AND s.day = d.day)
    SELECT location, strftime(day, '%Y-%m-%d') AS day, round(value + 1.3717e-8, 6) AS value,
           round(avg(value) OVER (PARTITION BY location ORDER BY day ROWS 6 PRECEDING) + 1.3717e-8, 6) AS mean_7,
           round(avg(value) OVER (PARTITION BY location ORDER BY day ROWS 29 PRECEDING) + 1.3717e-8, 6) AS mean_30
    FROM f
    """,
    obs=True,
)
def rolling_mean_rows(spark, sf_dir):
    """The five most frequent places on a common calendar, filled both ways, then averaged over rows."""
    top = semi_topk(observations(spark, sf_dir), "location", 5)
    daily = windows.complete_days(windows.daily_mean(top, ["location"], "ts", "tax"), ["location"])
    rolled = windows.rolling_mean_rows(daily, ["location"], "day")
    return rounded(with_days(rolled, "day"), 6, "value", "mean_7", "mean_30")


MONTH_SPINE = f"""
    {GAPPED},
    m AS (SELECT location, last_day(ts) AS month_end, avg(tax) AS value FROM gapped GROUP BY ALL),
    spine AS (SELECT location, last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)),
                date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM m GROUP BY location)"""


@query(
    "calendar_spine",
    f"""
    WITH {MONTH_SPINE}
    SELECT location, strftime(month_end, '%Y-%m-%d') AS month_end, round(value + 1.3717e-8, 6) AS value
    FROM spine LEFT JOIN m USING (location, month_end)
    """,
    obs=True,
)
def calendar_spine(spark, sf_dir):
    monthly = agg.monthly_mean(_gapped(spark, sf_dir), ["location"], "ts", ["tax"])
    full = windows.complete_months(monthly, ["location"], fill=False)
    return rounded(with_days(full, "month_end"), 6, "value")


@query(
    "fill_both_ways",
    f"""
    WITH {MONTH_SPINE}
    SELECT s.location, strftime(s.month_end, '%Y-%m-%d') AS month_end, round(coalesce(
      last_value(value IGNORE NULLS) OVER (PARTITION BY s.location ORDER BY s.month_end
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(value IGNORE NULLS) OVER (PARTITION BY s.location ORDER BY s.month_end
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 1.3717e-8, 6) AS value
    FROM spine s LEFT JOIN m ON m.location = s.location AND m.month_end = s.month_end
    """,
    obs=True,
)
def fill_both_ways(spark, sf_dir):
    monthly = agg.monthly_mean(_gapped(spark, sf_dir), ["location"], "ts", ["tax"])
    return rounded(with_days(windows.complete_months(monthly, ["location"]), "month_end"), 6, "value")


def corr_sql(key: str, at: str, moment: str, a: str, b: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY {at} ROWS 29 PRECEDING)"
    return f"""
    WITH pairs AS (SELECT {key}, {moment} AS {at}, avg({a}) AS {a}, avg({b}) AS {b} FROM obs GROUP BY ALL
                   HAVING avg({a}) IS NOT NULL AND avg({b}) IS NOT NULL),
    enough AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS pairs FROM pairs)
    SELECT {key}, strftime({at}, '%Y-%m-%d') AS {at}, round({a} + 1.3717e-6, 4) AS {a}, round({b} + 1.3717e-6, 4) AS {b},
           round(CASE WHEN count(*) {w} >= 10
                 THEN covar_samp({a}, {b}) {w} / (stddev_samp({a}) {w} * stddev_samp({b}) {w}) END + 1.3717e-7, 5)
             AS rolling_corr
    FROM enough WHERE pairs > 30
    """


@query("rolling_corr_months", corr_sql("location", "month_end", "last_day(ts)", "quantity", "tax"), obs=True)
def rolling_corr_months(spark, sf_dir):
    rolled = windows.rolling_corr(observations(spark, sf_dir), ["location"], "ts", "quantity", "tax")
    return rounded(rounded(with_days(rolled, "month_end"), 4, "quantity", "tax"), 5, "rolling_corr")


@query("rolling_corr_dates", corr_sql("state", "day", "CAST(ts AS DATE)", "quantity", "discount"), obs=True)
def rolling_corr_dates(spark, sf_dir):
    rolled = windows.rolling_corr(observations(spark, sf_dir), ["state"], "ts", "quantity", "discount", grain="day")
    return rounded(rounded(with_days(rolled, "day"), 4, "quantity", "discount"), 5, "rolling_corr")


@query(
    "zscore_spikes",
    """
    WITH s AS (SELECT user_id, event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY ALL)
    SELECT event_id, round((value - m) / nullif(sd, 0) + 1.3717e-7, 5) AS zscore,
           coalesce(abs((value - m) / nullif(sd, 0)) > 2.5, false) AS is_spike
    FROM events JOIN s USING (user_id, event_type)
    """,
)
def zscore_spikes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    scored = windows.zscore_spikes(events, ["user_id", "event_type"], "value", 2.5)
    return rounded(scored.select("event_id", "zscore", "is_spike"), 5, "zscore")


@query("series_count", "SELECT user_id, event_type, count(*) AS points FROM events GROUP BY ALL")
def series_count(spark, sf_dir):
    return windows.series_count(table(spark, sf_dir, "events"), ["user_id", "event_type"])


# --- models ----------------------------------------------------------------------------


@query("stl_decomposition")
def stl_decomposition(spark, sf_dir):
    return stl(observations(spark, sf_dir), ["location"], "ts", MEASURES)


def _all_gapped(spark, sf_dir):
    """Every measure without the same months."""
    known = ~F.month("ts").isin(2, 5, 6)
    return observations(spark, sf_dir).withColumns({m: F.when(known, F.col(m)) for m in MEASURES})


@query("stl_decomposition_filled")
def stl_decomposition_filled(spark, sf_dir):
    """The calendar is completed and filled before the decomposition."""
    return stl(_all_gapped(spark, sf_dir), ["state"], "ts", MEASURES, gaps="fill")


def _closed(parts):
    """Months, observed values and status, and whether the parts add up to what was observed."""
    sums = F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("observed")) <= 1e-9 * F.greatest(F.abs("observed"), F.lit(1.0))
    told = parts.withColumn("closed", F.when(F.col("status") == "ok", F.coalesce(sums, F.lit(False))))
    return rounded(with_days(told.drop("trend", "seasonal", "resid"), "month_end"), 4, "observed")


STATUS = """CASE WHEN count(*) OVER (PARTITION BY {0}, measure) > 24 THEN 'ok' ELSE 'too few points' END AS status,
      CASE WHEN count(*) OVER (PARTITION BY {0}, measure) > 24 THEN TRUE END AS closed"""


@query(
    "stl_series",
    f"""
    WITH m AS (SELECT location, measure, last_day(ts) AS month_end, avg(value) AS observed FROM long GROUP BY ALL)
    SELECT location, measure, strftime(month_end, '%Y-%m-%d') AS month_end, round(observed + 1.3717e-6, 4) AS observed,
      {STATUS.format("location")}
    FROM m
    """,
    long=True,
)
def stl_series(spark, sf_dir):
    return _closed(stl(observations(spark, sf_dir), ["location"], "ts", MEASURES))


@query(
    "stl_series_filled",
    f"""
    WITH m AS (SELECT state, measure, last_day(ts) AS month_end, avg(value) AS value FROM long WHERE month(ts) NOT IN (2, 5, 6) GROUP BY ALL),
    spine AS (
      SELECT e.state, e.measure, last_day(CAST(unnest(generate_series(date_trunc('month', e.low), date_trunc('month', e.high), INTERVAL 1 MONTH)) AS DATE)) AS month_end
      FROM (SELECT state, measure, min(month_end) AS low, max(month_end) AS high FROM m GROUP BY ALL) e
    ), filled AS (
      SELECT s.state, s.measure, s.month_end,
        coalesce(m.value, last_value(m.value IGNORE NULLS) OVER (PARTITION BY s.state, s.measure ORDER BY s.month_end)) AS observed
      FROM spine s LEFT JOIN m ON m.state = s.state AND m.measure = s.measure AND m.month_end = s.month_end
    )
    SELECT state, measure, strftime(month_end, '%Y-%m-%d') AS month_end, round(observed + 1.3717e-6, 4) AS observed,
      {STATUS.format("state")}
    FROM filled
    """,
    long=True,
)
def stl_series_filled(spark, sf_dir):
    return _closed(stl(_all_gapped(spark, sf_dir), ["state"], "ts", MEASURES, gaps="fill"))


@query("arima_forecast")
def arima(spark, sf_dir):
    return arima_forecast(observations(spark, sf_dir), ["location"], "ts", MEASURES)


@query(
    "arima_calendar",
    """
    WITH m AS (SELECT location, measure, last_day(ts) AS month_end FROM long GROUP BY ALL),
    s AS (SELECT location, measure, count(*) AS n, max(month_end) AS last FROM m GROUP BY ALL)
    SELECT location, measure, CAST(i AS INT) AS step, strftime(last_day(last + to_months(CAST(i AS INT))), '%Y-%m-%d') AS month_end,
           'ok' AS status, CASE WHEN i >= 3 THEN TRUE END AS steady, TRUE AS widening
    FROM s, range(1, 13) t(i) WHERE n > 24
    UNION ALL SELECT location, measure, 0, NULL, 'too few points', NULL, NULL FROM s WHERE n <= 24
    """,
    long=True,
)
def arima_calendar(spark, sf_dir):
    """Steps, months and status of the forecasts; changes shrink by a constant factor and errors never do."""
    made = arima_forecast(observations(spark, sf_dir), ["location"], "ts", MEASURES)
    order = Window.partitionBy("location", "measure").orderBy("step")
    change = F.col("forecast") - F.lag("forecast").over(order)
    told = made.withColumn("change", change).withColumn("before", F.lag("change").over(order))
    told = told.withColumn("first", F.first("forecast").over(order))
    # Every change is the one before times phi, which is that of the second and third step.
    factor = F.first(F.when(F.col("step") == 3, ratio(F.col("change"), F.col("before"))), ignorenulls=True)
    told = told.withColumn("phi", factor.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    near = F.abs(F.col("change") - F.coalesce("phi", F.lit(0.0)) * F.col("before")) <= 1e-9 * F.greatest(F.abs("first"), F.lit(1.0))
    wider = F.col("std_error") >= F.coalesce(F.lag("std_error").over(order), F.lit(0.0))
    told = told.withColumn("steady", F.when(F.col("step") >= 3, near)).withColumn("widening", wider)
    return with_days(told.select("location", "measure", "step", "month_end", "status", "steady", "widening"), "month_end")


MATRIX = """
    m AS (SELECT state, measure, last_day(ts) AS month_end, avg(value) AS value FROM long GROUP BY ALL),
    cells AS (SELECT e.state, e.measure, t.month_end, coalesce(m.value, 0) AS value
             FROM (SELECT DISTINCT state, measure FROM m) e CROSS JOIN (SELECT DISTINCT month_end FROM m) t
             LEFT JOIN m ON m.state = e.state AND m.measure = e.measure AND m.month_end = t.month_end)"""


def _matrix(spark, sf_dir):
    return clustering.feature_matrix(observations(spark, sf_dir), ["state"], "ts", MEASURES)


def _cells(matrix, column):
    pairs = F.arrays_zip(F.col("months").alias("month_end"), F.col(column).alias("value"))
    return with_days(matrix.select("state", "measure", F.inline(pairs)), "month_end")


@query(
    "feature_matrix",
    f"WITH {MATRIX} SELECT state, measure, strftime(month_end, '%Y-%m-%d') AS month_end, round(value + 1.3717e-6, 4) AS value FROM cells",
    long=True,
)
def feature_matrix(spark, sf_dir):
    return rounded(_cells(_matrix(spark, sf_dir), "features"), 4, "value")


@query(
    "standardize",
    f"""
    WITH {MATRIX}, s AS (SELECT month_end, avg(value) AS mean, stddev_pop(value) AS std FROM cells GROUP BY ALL)
    SELECT state, measure, strftime(month_end, '%Y-%m-%d') AS month_end,
           round(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END + 1.3717e-7, 5) AS value
    FROM cells JOIN s USING (month_end)
    """,
    long=True,
)
def standardize(spark, sf_dir):
    return rounded(_cells(clustering.standardize(_matrix(spark, sf_dir)), "scaled"), 5, "value")


def _kmeans_sql(entity: str, k: int, result: str, measures: str = "TRUE", restarts: int = 10) -> str:
    """Seeding by the same hashes, Lloyd steps of all restarts, the best one, numbered by its smallest members."""
    uniform = "(('0x' || substr(md5(concat_ws('|', 'kmeans42', {r}, {j}, key)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496"
    return f"""
    WITH RECURSIVE m AS (
      SELECT {entity}, measure, last_day(ts) AS month_end, avg(value) AS value FROM long WHERE {measures} GROUP BY ALL
    ), cells AS (
      SELECT e.{entity}, e.measure, t.month_end, coalesce(m.value, 0) AS value
      FROM (SELECT DISTINCT {entity}, measure FROM m) e CROSS JOIN (SELECT DISTINCT month_end FROM m) t
      LEFT JOIN m ON m.{entity} = e.{entity} AND m.measure = e.measure AND m.month_end = t.month_end
    ), s AS (SELECT month_end, avg(value) AS mean, stddev_pop(value) AS std FROM cells GROUP BY ALL),
    points AS (
      SELECT {entity}, measure, {entity} || '|' || measure AS key,
             list(round(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END, 9) ORDER BY month_end) AS x
      FROM cells JOIN s USING (month_end) GROUP BY ALL
    ), raced AS (
      SELECT r::VARCHAR AS r, 0 AS j, key, x, CAST('Infinity' AS DOUBLE) AS near, NULL::DOUBLE[] AS centre
      FROM points, range({restarts}) t(r)
      UNION ALL
      SELECT a.r, a.j + 1, a.key, a.x, least(a.near, pow(list_distance(a.x, b.x), 2)), b.x
      FROM raced a JOIN (
        SELECT r, arg_min(x, (CASE WHEN j = 0 THEN -ln({uniform.format(r="r", j="j")}) WHEN near > 0 THEN -ln({uniform.format(r="r", j="j")}) / near
                              ELSE CAST('Infinity' AS DOUBLE) END, key)) AS x
        FROM raced GROUP BY r) b USING (r)
      WHERE a.j < least({k}, (SELECT count(*) FROM points))
    ), lloyd AS (
      SELECT DISTINCT 0 AS lap, r, j - 1 AS c, centre, TRUE AS moving FROM raced WHERE j > 0
      UNION ALL
      SELECT lap + 1, r, c, new, max(list_distance(centre, new)) OVER (PARTITION BY r) > 1e-4 FROM (
        SELECT l.lap, l.r, l.c, l.centre, coalesce(n.new, l.centre) AS new FROM lloyd l LEFT JOIN (
          SELECT r, c, list(v ORDER BY i) AS new FROM (
            SELECT r, c, i, avg(x[i]) AS v FROM (
              SELECT r, key, x, arg_min(c, (list_distance(x, centre), c)) AS c FROM lloyd, points GROUP BY r, key, x
            ), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY r, c, i
          ) GROUP BY r, c
        ) n USING (r, c) WHERE l.moving AND l.lap < 300)
    ), ended AS (SELECT r, c, arg_max(centre, lap) AS centre FROM lloyd GROUP BY r, c
    ), cost AS (
      SELECT r, sum(near) AS cost FROM (SELECT r, key, min(pow(list_distance(x, centre), 2)) AS near FROM ended, points GROUP BY r, key) GROUP BY r
    ), labelled AS (
      SELECT {entity}, measure, arg_min(c, (list_distance(x, centre), c)) AS c
      FROM ended, points WHERE r = (SELECT r FROM cost ORDER BY round(cost, 4), r::INT LIMIT 1) GROUP BY {entity}, measure
    ), numbers AS (
      SELECT c, row_number() OVER (ORDER BY min(({entity}, measure))) - 1 AS cluster FROM labelled GROUP BY c
    ), clustered AS (SELECT {entity}, measure, cluster FROM labelled JOIN numbers USING (c))
    {result}
    """


def _assigned(entity: str) -> str:
    return f"SELECT {entity}, measure, CAST(cluster AS INT) AS cluster FROM clustered"


@query("kmeans_states", _kmeans_sql("state", 5, _assigned("state")), long=True)
def kmeans_states(spark, sf_dir):
    clustered = clustering.kmeans(_matrix(spark, sf_dir), ["state"])
    return clustering.cluster_assignments(clustered, ["state"])


@query("kmeans_locations", _kmeans_sql("location", 3, _assigned("location"), "measure = 'price'"), long=True)
def kmeans_locations(spark, sf_dir):
    """Locations by the course of one measure."""
    matrix = clustering.feature_matrix(observations(spark, sf_dir), ["location"], "ts", ["price"])
    return clustering.cluster_assignments(clustering.kmeans(matrix, ["location"], k=3), ["location"])


@query(
    "cluster_trends",
    _kmeans_sql(
        "state",
        5,
        """SELECT CAST(cluster AS INT) AS cluster, strftime(month_end, '%Y-%m-%d') AS month_end, round(avg(value) + 1.3717e-6, 4) AS value
           FROM clustered JOIN cells USING (state, measure) GROUP BY ALL""",
    ),
    long=True,
)
def cluster_trends(spark, sf_dir):
    trends = clustering.cluster_trends(clustering.kmeans(_matrix(spark, sf_dir), ["state"]))
    return rounded(with_days(trends, "month_end"), 4, "value")


# Greedy merging: every step takes the closest pair of all clusters.
GREEDY = """
    WITH RECURSIVE profile AS (
      SELECT location, [avg(quantity), avg(price), avg(discount), avg(tax)] AS centre FROM obs GROUP BY location
    ), state AS (
      SELECT CAST(-1 AS BIGINT) AS step, row_number() OVER (ORDER BY location) - 1 AS node, CAST(1 AS BIGINT) AS size, centre,
             CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST(NULL AS DOUBLE) AS height, count(*) OVER () AS n
      FROM profile
      UNION ALL
      SELECT s.step + 1, CASE WHEN s.node = b.l THEN s.n + s.step + 1 ELSE s.node END,
             CASE WHEN s.node = b.l THEN b.size ELSE s.size END, CASE WHEN s.node = b.l THEN b.centre ELSE s.centre END,
             CASE WHEN s.node = b.l THEN b.l END, CASE WHEN s.node = b.l THEN b.r END, CASE WHEN s.node = b.l THEN b.height END, s.n
      FROM state s, (
        SELECT x.node AS l, y.node AS r, x.size + y.size AS size,
               [(x.centre[i] * x.size + y.centre[i] * y.size) / (x.size + y.size) FOR i IN range(1, 5)] AS centre,
               sqrt(2.0 * x.size * y.size / (x.size + y.size)) * list_distance(x.centre, y.centre) AS height
        FROM state x JOIN state y ON x.node < y.node ORDER BY height, l, r LIMIT 1
      ) b WHERE s.node <> b.r
    )
    SELECT step, l AS "left", r AS "right", round(height + 1.3717e-5, 3) AS height, size FROM state WHERE l IS NOT NULL
"""


@query("ward_linkage", GREEDY, obs=True)
def ward(spark, sf_dir):
    profile = agg.profile_means(observations(spark, sf_dir), ["location"], MEASURES)
    return rounded(ward_linkage(profile, "location", MEASURES), 3, "height")
