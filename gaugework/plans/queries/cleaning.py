"""Sources, cleaning, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.scalars import display, label, to_number
from gaugework.functions.temporal import parse_date, parse_month_code
from gaugework.operators import aggregates as agg
from gaugework.operators import cleaning as ops
from gaugework.operators import filters, joins
from gaugework.plans.cleaning import clean_observations
from gaugework.plans.fixtures import MEASURES, coordinates, observations, table
from gaugework.plans.queries.base import as_long, day, query, rounded, with_days
from gaugework.session import scratch_path
from gaugework.sources import export_filtered, malformed_lines, read_observations, read_table, write_csv, write_table


@query(
    "read_clean_csv",
    """
    SELECT state, year(ts) AS year, month(ts) AS month, count(*) AS n, round(avg(quantity) + 1.3717e-6, 4) AS quantity,
           round(avg(coalesce(tax, (SELECT avg(tax) FROM obs))) + 1.3717e-8, 6) AS tax
    FROM obs GROUP BY ALL
    """,
    obs=True,
)
def read_clean_csv(spark, sf_dir):
    obs = observations(spark, sf_dir)
    raw = obs.select(
        F.date_format("ts", "MMMM - 'M'MMyyyy").alias("sampling_date"),
        "state",
        "location",
        F.concat(F.lit(" "), F.col("quantity").cast("string")).alias("quantity"),
        F.coalesce(F.col("tax").cast("string"), F.lit("NA")).alias("tax"),
    )
    path = scratch_path(spark, "raw-csv")
    write_csv(raw, path)
    clean = clean_observations(read_observations(spark, path), ["quantity", "tax"], required=["date", "state"])
    means = clean.groupBy("state", "year", "month").agg(
        F.count("*").alias("n"), F.avg("quantity").alias("quantity"), F.avg("tax").alias("tax")
    )
    return rounded(rounded(as_long(means, "year", "month"), 4, "quantity"), 6, "tax")


@query(
    "malformed_csv_lines",
    """
    SELECT CASE s_suppkey % 6 WHEN 1 THEN 'short' WHEN 2 THEN 'long' ELSE 'quotes' END AS problem,
           count(*) AS n, sum(s_suppkey)::BIGINT AS keys
    FROM supplier WHERE s_suppkey % 6 IN (1, 2, 3, 4) GROUP BY 1
    """,
)
def malformed_csv_lines(spark, sf_dir):
    """Suppliers as lines, a part of them too short, too long, with an open quote or with one inside a field."""
    key, name = F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), F.col("s_name"), F.lit(', ""Ltd"""'))
    broken = {1: [key, name], 2: [key, name, F.lit("1"), F.lit("x")], 3: [key, F.lit("1"), F.lit('"open')], 4: [key, F.lit('in"side'), F.lit("1")]}
    line = F.concat_ws(",", key, name, F.lit("1"))
    for rest, parts in broken.items():
        line = F.when(F.col("s_suppkey") % 6 == rest, F.concat_ws(",", *parts)).otherwise(line)
    path = scratch_path(spark, "lines")
    lines = table(spark, sf_dir, "supplier").select(line.alias("key,name,value"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    found = malformed_lines(spark, path)
    keys = F.sum(F.split("line", ",")[0].cast("long"))
    return found.groupBy("problem").agg(F.count("*").alias("n"), keys.alias("keys"))


@query(
    "table_by_year",
    """
    SELECT location, count(*) AS n, round(sum(quantity) + 1.3717e-4, 2) AS quantity FROM obs
    WHERE year(ts) IN (1995, 1997) GROUP BY location
    """,
    obs=True,
)
def table_by_year(spark, sf_dir):
    """Observations laid out by year, of which only two years' folders are read back."""
    path = scratch_path(spark, "by-year")
    write_table(observations(spark, sf_dir).select("location", "ts", "quantity"), path, "ts")
    years = read_table(spark, path).where(F.col("year").isin(1995, 1997))
    sums = years.groupBy("location").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    return rounded(sums, 2, "quantity")


@query(
    "export_filtered_csv",
    """
    SELECT location, count(*) AS n, round(sum(quantity) + 1.3717e-4, 2) AS quantity FROM obs
    WHERE state IN ('ASIA', 'EUROPE') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
    GROUP BY location
    """,
    obs=True,
)
def export_filtered_csv(spark, sf_dir):
    picked = filters.Selection({"state": ["ASIA", "EUROPE"]}, "ts", "1996-01-01", "1998-12-31")
    path = scratch_path(spark, "export")
    export_filtered(observations(spark, sf_dir).select("state", "location", "ts", "quantity"), picked, path)
    back = read_observations(spark, path).withColumn("quantity", to_number("quantity"))
    sums = back.groupBy("location").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    return rounded(sums, 2, "quantity")


@query(
    "normalize_missing",
    """
    SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag, count(*) AS n,
           count(nullif(l_discount, 0)) AS discounts, round(avg(nullif(l_discount, 0)) + 1.3717e-8, 6) AS discount
    FROM lineitem GROUP BY 1
    """,
)
def normalize_missing(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", " NA").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("discount"),
    )
    grouped = ops.normalize_missing(line).groupBy("flag")
    means = grouped.agg(
        F.count("*").alias("n"), F.count("discount").alias("discounts"), F.avg("discount").alias("discount")
    )
    return rounded(means, 6, "discount")


@query(
    "profile_schema",
    """
    SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(o_orderkey) AS non_null, count(*) AS total FROM orders
    UNION ALL SELECT 'o_custkey', 'bigint', count(o_custkey), count(*) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus), count(*) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', count(o_totalprice), count(*) FROM orders
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(o_orderdate), count(*) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority), count(*) FROM orders
    """,
)
def profile_schema(spark, sf_dir):
    return agg.profile_schema(table(spark, sf_dir, "orders"))


@query(
    "preview",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, event_type, round(value + 1.3717e-6, 4) AS value
    FROM events ORDER BY event_id LIMIT 5
    """,
)
def preview(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return rounded(with_days(agg.preview(events, ["event_id"]), "ts"), 4, "value")


@query(
    "parse_month_code",
    """
    SELECT CASE WHEN l_returnflag <> 'R' THEN strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') END AS parsed,
           l_returnflag AS form, count(*) AS n
    FROM lineitem GROUP BY 1, 2
    """,
)
def parse_month_codes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate")
    text = (
        F.when(F.col("l_returnflag") == "A", F.date_format("l_shipdate", "MMMM - 'M'MMyyyy"))
        .when(F.col("l_returnflag") == "N", F.date_format("l_shipdate", "'x-y - m'Myyyy ' '"))
        .otherwise(F.date_format("l_shipdate", "MMMM - 'M13'yyyy"))
    )
    parsed = line.select(day(parse_month_code(text)).alias("parsed"), F.col("l_returnflag").alias("form"))
    return parsed.groupBy("parsed", "form").agg(F.count("*").alias("n"))


@query(
    "parse_date",
    """
    SELECT CASE WHEN l_returnflag <> 'R' THEN strftime(l_shipdate, '%Y-%m-%d') END AS parsed,
           l_returnflag AS form, count(*) AS n
    FROM lineitem GROUP BY 1, 2
    """,
)
def parse_dates(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate")
    text = (
        F.when(F.col("l_returnflag") == "A", F.date_format("l_shipdate", "dd-MM-yyyy"))
        .when(F.col("l_returnflag") == "N", F.date_format("l_shipdate", "d/M/yyyy"))
        .otherwise(F.date_format("l_shipdate", "'31-02-'yyyy"))
    )
    parsed = line.select(day(parse_date(text)).alias("parsed"), F.col("l_returnflag").alias("form"))
    return parsed.groupBy("parsed", "form").agg(F.count("*").alias("n"))


@query(
    "resolve_time_date_parts",
    """
    SELECT year(ts) AS year, month(ts) AS month, 1 AS day, count(*) AS n FROM obs GROUP BY ALL
    """,
    obs=True,
)
def resolve_time_date_parts(spark, sf_dir):
    obs = observations(spark, sf_dir)
    raw = obs.select(F.date_format("ts", "MMMM - 'M'MMyyyy").alias("sampling_date"))
    dated = ops.add_date_parts(ops.resolve_time(raw), "date")
    return as_long(dated.groupBy("year", "month", "day").agg(F.count("*").alias("n")), "year", "month").withColumn(
        "day", F.col("day").cast("int")
    )


@query(
    "to_number",
    """
    SELECT l_linenumber % 5 AS form, count(*) AS n,
           count(CASE WHEN l_linenumber % 5 < 3 THEN l_quantity END) AS numbers,
           round(sum(CASE WHEN l_linenumber % 5 < 3 THEN l_quantity END) + 1.3717e-4, 2) AS total
    FROM lineitem GROUP BY 1
    """,
)
def to_numbers(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 5).alias("form"), "l_quantity")
    plain = F.col("l_quantity").cast("string")
    text = (
        F.when(F.col("form") == 0, plain)
        .when(F.col("form") == 1, F.concat(F.lit("  "), plain, F.lit(" ")))
        .when(F.col("form") == 2, F.concat((F.col("l_quantity") * 10).cast("string"), F.lit("e-1")))
        .when(F.col("form") == 3, F.concat(plain, F.lit("d")))
        .otherwise("NA")
    )
    read = line.select("form", to_number(text).alias("x"))
    sums = read.groupBy("form").agg(F.count("*").alias("n"), F.count("x").alias("numbers"), F.sum("x").alias("total"))
    return rounded(sums, 2, "total")


@query(
    "impute_mean",
    """
    SELECT location, count(*) AS n, round(avg(coalesce(tax, (SELECT avg(tax) FROM obs))) + 1.3717e-8, 6) AS tax,
           round(avg(quantity) + 1.3717e-6, 4) AS quantity
    FROM obs GROUP BY location
    """,
    obs=True,
)
def impute_mean(spark, sf_dir):
    obs = observations(spark, sf_dir).select("location", "tax", "quantity")
    filled = ops.impute_mean(obs, ["tax", "quantity"]).groupBy("location")
    means = filled.agg(F.count("*").alias("n"), F.avg("tax").alias("tax"), F.avg("quantity").alias("quantity"))
    return rounded(rounded(means, 6, "tax"), 4, "quantity")


@query("drop_missing", "SELECT type, count(*) AS n FROM obs WHERE tax IS NOT NULL GROUP BY type", obs=True)
def drop_missing(spark, sf_dir):
    kept = ops.drop_missing(observations(spark, sf_dir), ["tax", "state"])
    return kept.groupBy("type").agg(F.count("*").alias("n"))


@query(
    "melt",
    """
    SELECT type, measure, count(*) AS n, round(sum(value) + 1.3717e-4, 2) AS total, min(value) AS low, max(value) AS high
    FROM long GROUP BY ALL
    """,
    long=True,
)
def melt(spark, sf_dir):
    long = ops.melt(observations(spark, sf_dir), ["type"], MEASURES)
    sums = long.groupBy("type", "measure").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return rounded(sums, 2, "total")


@query(
    "melt_matrix",
    """
    WITH cells AS (SELECT year(ts) AS year, month(ts) AS month, avg(price) AS value FROM obs GROUP BY ALL),
    years AS (SELECT DISTINCT year FROM cells)
    SELECT y.year AS year, CAST(m.month AS VARCHAR) AS month, round(c.value + 1.3717e-6, 4) AS value
    FROM years y CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m
    LEFT JOIN cells c ON c.year = y.year AND c.month = m.month
    """,
    obs=True,
)
def melt_matrix(spark, sf_dir):
    matrix = agg.month_year_pivot(observations(spark, sf_dir), "ts", "price", rows="year")
    return rounded(as_long(ops.melt_matrix(matrix, ["year"], "month"), "year"), 4, "value")


@query(
    "add_interval",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS start, strftime(ts + INTERVAL 10 DAY, '%Y-%m-%d') AS "end" FROM events
    """,
)
def add_interval(spark, sf_dir):
    bars = ops.add_interval(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")
    return with_days(bars, "start", "end")


@query(
    "labels_and_columns",
    """
    SELECT upper(event_type) AS label, printf('%.2f', max(value)) AS highest, CAST(count(*) AS VARCHAR) AS n
    FROM events GROUP BY event_type
    """,
)
def labels_and_columns(spark, sf_dir):
    events = ops.pick(table(spark, sf_dir, "events"), ["event_type", "value"])
    tops = events.groupBy("event_type").agg(F.max("value").alias("top"), F.count("*").alias("n"))
    return tops.select(
        label("event_type").alias("label"), display("top").alias("highest"), F.col("n").cast("string").alias("n")
    )


# --- filters ---------------------------------------------------------------------------


@query(
    "filter_in",
    """
    SELECT state, location, count(*) AS n FROM obs
    WHERE state IN ('ASIA', 'AFRICA') AND location IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)
    GROUP BY ALL
    """,
    obs=True,
)
def filter_in(spark, sf_dir):
    obs = observations(spark, sf_dir).select("state", "location")
    wanted = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_name")
    kept = filters.filter_in(filters.filter_in(obs, "state", ["ASIA", "AFRICA"]), "location", wanted)
    return kept.groupBy("state", "location").agg(F.count("*").alias("n"))


@query(
    "filter_between",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS ts, count(*) AS n FROM obs
    WHERE ts BETWEEN TIMESTAMP '1997-02-01' AND TIMESTAMP '1997-06-30' GROUP BY 1
    """,
    obs=True,
)
def filter_between(spark, sf_dir):
    kept = filters.filter_between(observations(spark, sf_dir).select("ts"), "ts", "1997-02-01", "1997-06-30")
    return with_days(kept.groupBy("ts").agg(F.count("*").alias("n")), "ts")


@query(
    "filter_eq",
    """
    SELECT event_id, user_id, round(value + 1.3717e-6, 4) AS value FROM events WHERE event_type = 'error' AND user_id = 7
    """,
)
def filter_eq(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return rounded(filters.filter_eq(events, event_type="error", user_id=7).drop("event_type"), 4, "value")


@query(
    "filter_options",
    """
    SELECT 'state' AS "column", state AS value FROM (SELECT DISTINCT state FROM obs ORDER BY 1 LIMIT 3)
    UNION ALL SELECT 'location', location FROM (SELECT DISTINCT location FROM obs ORDER BY 1 LIMIT 5)
    """,
    obs=True,
)
def filter_options(spark, sf_dir):
    obs = observations(spark, sf_dir)
    states = filters.options(obs, "state", 3).select(F.lit("state").alias("column"), F.col("state").alias("value"))
    places = filters.options(obs, "location", 5).select(
        F.lit("location").alias("column"), F.col("location").alias("value")
    )
    return states.unionByName(places)


@query(
    "time_bounds",
    "SELECT strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM obs",
    obs=True,
)
def time_bounds(spark, sf_dir):
    return with_days(filters.time_bounds(observations(spark, sf_dir), "ts"), "first", "last")


@query(
    "last_period",
    """
    SELECT p.period AS period, count(*) AS n, round(sum(price) + 1.3717e-4, 2) AS price FROM obs,
      (SELECT '1 month' AS period, max(ts) - INTERVAL 1 MONTH AS since FROM obs
       UNION ALL SELECT '6 months', max(ts) - INTERVAL 6 MONTH FROM obs
       UNION ALL SELECT '1 year', max(ts) - INTERVAL 1 YEAR FROM obs) p
    WHERE ts >= since GROUP BY p.period
    """,
    obs=True,
)
def last_period(spark, sf_dir):
    obs = observations(spark, sf_dir).select("ts", "price")
    periods = {"1 month": (1, "month"), "6 months": (6, "months"), "1 year": (1, "year")}
    tagged = filters.last_periods(obs, "ts", periods)
    return rounded(tagged.groupBy("period").agg(F.count("*").alias("n"), F.sum("price").alias("price")), 2, "price")


@query(
    "last_month",
    """
    SELECT state, count(*) AS n, round(sum(price) + 1.3717e-4, 2) AS price FROM obs
    WHERE ts >= (SELECT max(ts) FROM obs) - INTERVAL 1 MONTH GROUP BY state
    """,
    obs=True,
)
def last_month(spark, sf_dir):
    kept = filters.last_period(observations(spark, sf_dir).select("state", "ts", "price"), "ts", 1, "month")
    return rounded(kept.groupBy("state").agg(F.count("*").alias("n"), F.sum("price").alias("price")), 2, "price")


@query(
    "gate_series",
    """
    WITH counts AS (SELECT user_id, event_type, count(*) AS points FROM events GROUP BY ALL)
    SELECT e.event_id, c.points, CASE WHEN c.points > 14 THEN 'ok' ELSE 'too few points' END AS status
    FROM events e JOIN counts c ON e.user_id = c.user_id AND e.event_type = c.event_type
    """,
)
def gate_series(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return filters.gate(events, ["user_id", "event_type"], 14).select("event_id", "points", "status")


# --- joins -----------------------------------------------------------------------------


@query(
    "lookup_coordinates",
    """
    SELECT location, count(*) AS n, any_value(8.0 + n_nationkey * 1.25) AS lat,
           any_value(68.0 + (n_nationkey * 7) % 28) AS lon
    FROM obs JOIN nation ON location = n_name WHERE n_nationkey <> 7 GROUP BY location
    """,
    obs=True,
)
def lookup_coordinates(spark, sf_dir):
    located = joins.lookup(observations(spark, sf_dir).select("location"), coordinates(spark, sf_dir), "location")
    return located.groupBy("location").agg(
        F.count("*").alias("n"), F.any_value("lat").cast("double").alias("lat"), F.any_value("lon").cast("double").alias("lon")
    )


@query(
    "semi_topk",
    """
    SELECT location, type, count(*) AS n FROM obs
    WHERE location IN (SELECT location FROM obs GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 5) GROUP BY ALL
    """,
    obs=True,
)
def semi_topk(spark, sf_dir):
    kept = joins.semi_topk(observations(spark, sf_dir).select("location", "type"), "location", 5)
    return kept.groupBy("location", "type").agg(F.count("*").alias("n"))


@query(
    "broadcast_scalar",
    """
    SELECT event_id, round(value - (SELECT avg(value) FROM events) + 1.3717e-6, 4) AS deviation FROM events
    """,
)
def broadcast_scalar(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    mean = joins.one_row(events.agg(F.avg("value").alias("mean")))["mean"]
    return rounded(events.select("event_id", (F.col("value") - mean).alias("deviation")), 4, "deviation")


@query(
    "align_on_time",
    """
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
           round(avg(CASE WHEN event_type = 'click' THEN value END) + 1.3717e-6, 4) AS click,
           round(avg(CASE WHEN event_type = 'view' THEN value END) + 1.3717e-6, 4) AS view
    FROM events GROUP BY 1, 2 HAVING click IS NOT NULL AND view IS NOT NULL
    """,
)
def align_on_time(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", day("ts").alias("day"), "event_type", "value")
    pairs = joins.align_on_time(events, ["user_id", "day"], "event_type", "value", "click", "view")
    return rounded(pairs, 4, "click", "view")
