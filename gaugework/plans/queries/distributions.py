"""Histograms, box statistics, densities, hexagons, bands, maps and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import distributions as dist
from gaugework.operators import text as words
from gaugework.plans.fixtures import MEASURES, coordinates, observations, table
from gaugework.plans.queries.base import as_long, query, rounded, with_days


def histogram_sql(keys: list[str], bins: int) -> str:
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join(f"l.{c} = r.{c}" for c in [*keys, "measure"])
    back = " AND ".join(f"s.{c} = c.{c}" for c in [*keys, "measure", "bin"])
    pick = "".join(f"s.{c}, " for c in [*keys, "measure", "bin"])
    return f"""
    WITH ranges AS (SELECT {k}measure, min(value) AS low, max(value) AS high, (max(value) - min(value)) / {bins} AS width
                    FROM long GROUP BY ALL),
    counted AS (SELECT {"".join(f"l.{c}, " for c in keys)}l.measure,
                  CAST(len(list_filter(range(1, {bins}), lambda i: low + i * width <= value)) AS INT) AS bin, count(*) AS n
                FROM long l JOIN ranges r ON {on} GROUP BY ALL),
    spine AS (SELECT {k}measure, low, width, CAST(b AS INT) AS bin FROM ranges, (SELECT unnest(range({bins})) AS b))
    SELECT {pick}round(low + s.bin * width + 1.3717e-7, 5) AS "left", round(low + (s.bin + 1) * width + 1.3717e-7, 5) AS "right",
           coalesce(n, 0) AS n
    FROM spine s LEFT JOIN counted c ON {back}
    """


@query("histogram", histogram_sql([], 50), long=True)
def histogram(spark, sf_dir):
    return rounded(dist.histogram(observations(spark, sf_dir), MEASURES), 5, "left", "right")


@query("histogram_by_state", histogram_sql(["state"], 30), long=True)
def histogram_by_state(spark, sf_dir):
    return rounded(dist.histogram(observations(spark, sf_dir), MEASURES, 30, ["state"]), 5, "left", "right")


def box_sql(keys: list[str], final: str) -> str:
    k = "".join(f"{c}, " for c in keys)
    using = ", ".join([*keys, "measure"])
    return f"""
    WITH q AS (SELECT {k}measure, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                 quantile_cont(value, 0.75) AS q3 FROM rows GROUP BY ALL),
    f AS (SELECT *, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM q)
    {final.format(using=using, k=k)}
    """


BOX = """
    SELECT {k}measure, any_value(n) AS n, round(any_value(q1) + 1.3717e-7, 5) AS q1, round(any_value(median) + 1.3717e-7, 5) AS median,
           round(any_value(q3) + 1.3717e-7, 5) AS q3, min(CASE WHEN value BETWEEN lo AND hi THEN value END) AS whisker_low,
           max(CASE WHEN value BETWEEN lo AND hi THEN value END) AS whisker_high,
           count(*) FILTER (WHERE value < lo OR value > hi) AS outliers
    FROM rows JOIN f USING ({using}) GROUP BY ALL
"""


@query("box_stats", box_sql([], BOX).replace("rows", "long"), long=True)
def box_stats(spark, sf_dir):
    return rounded(dist.box_stats(observations(spark, sf_dir), MEASURES), 5, "q1", "median", "q3")


EVENTS_LONG = "rows AS (SELECT event_type, 'value' AS measure, value FROM events)"


@query("box_stats_by_group", box_sql(["event_type"], BOX).replace("WITH q", f"WITH {EVENTS_LONG}, q"))
def box_stats_by_group(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    return rounded(dist.box_stats(events, ["value"], ["event_type"]), 5, "q1", "median", "q3")


@query(
    "box_outliers",
    box_sql(
        ["event_type"],
        "SELECT {k}measure, round(value + 1.3717e-6, 4) AS value FROM rows JOIN f USING ({using}) WHERE value < lo OR value > hi",
    ).replace("WITH q", f"WITH {EVENTS_LONG}, q"),
)
def box_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    return rounded(dist.box_outliers(events, ["value"], ["event_type"]), 4, "value")


def kde_sql(key: str, source: str, points: int, first: str, last: str, factor: str, digits: int) -> str:
    k, lk = (f"{key}, ", f"l.{key} = g.{key} AND ") if key else ("", "")
    gk = f"g.{key}, " if key else ""
    return f"""
    WITH stats AS (SELECT {k}measure, count(*) AS n, min(value) AS low, max(value) AS high,
                     stddev_samp(value) * pow(count(*), -0.2) AS h FROM {source} GROUP BY ALL),
    spans AS (SELECT measure, min(low) AS g_low, max(high) AS g_high FROM stats GROUP BY ALL),
    grids AS (SELECT {k}measure, n, h, low, high, {first} AS first, {last} AS last
              FROM stats JOIN spans USING (measure) WHERE h > 0),
    grid AS (SELECT *, CAST(p AS INT) AS point, first + p * ((last - first) / {points - 1}) AS x
             FROM grids, (SELECT unnest(range({points})) AS p)),
    packed AS (SELECT {k}measure, value, count(*) AS c FROM {source} GROUP BY ALL)
    SELECT {gk}g.measure, g.point, round(g.x + 1.3717e-7, 5) AS x,
           round(sum(c * exp(-0.5 * ((g.x - l.value) / h) * ((g.x - l.value) / h))) * any_value({factor}) + 1.3717e-{digits + 2}, {digits})
             AS density
    FROM grid g JOIN packed l ON {lk}l.measure = g.measure
    GROUP BY {gk}g.measure, g.point, g.x
    """


PER_UNIT = "1.0 / (n * h * sqrt(2 * pi()))"
EVENTS_ALL = "(SELECT 'value' AS measure, value FROM events)"


@query("kde_as_counts", kde_sql("", EVENTS_ALL, 200, "low", "high", f"{PER_UNIT} * n * (high - low) / 50", 5))
def kde_as_counts(spark, sf_dir):
    """The density curve drawn over a 50-bin histogram."""
    events = table(spark, sf_dir, "events").select("value")
    return rounded(dist.kde(events, ["value"], scale="count", bins=50), 5, "x", "density")


@query(
    "kde_shared_grid",
    kde_sql("state", "long", 200, "g_low - (g_high - g_low) * 0.2", "g_high + (g_high - g_low) * 0.2", PER_UNIT, 7),
    long=True,
)
def kde_shared_grid(spark, sf_dir):
    """Densities per state on one grid per measure (ridgeline)."""
    curves = dist.kde(observations(spark, sf_dir), MEASURES, ["state"], grid="shared", pad=0.2)
    return rounded(rounded(curves, 5, "x"), 7, "density")


@query(
    "kde_own_grid",
    kde_sql(
        "event_type",
        "(SELECT event_type, 'value' AS measure, value FROM events)",
        100,
        "low - 2 * h",
        "high + 2 * h",
        PER_UNIT,
        8,
    ),
)
def kde_own_grid(spark, sf_dir):
    """Densities per group that run two bandwidths past the data (violin)."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    curves = dist.kde(events, ["value"], ["event_type"], points=100, cut=2.0)
    return rounded(rounded(curves, 5, "x"), 8, "density")


@query(
    "hexbin",
    """
    WITH pts AS (SELECT quantity AS x, price AS y FROM obs),
    ext AS (SELECT min(x) AS a, max(x) AS b, min(y) AS y0, (max(y) - min(y)) / 17 AS sy FROM pts),
    box AS (SELECT a - (b - a) * 1e-9 AS x0, (b + (b - a) * 1e-9 - (a - (b - a) * 1e-9)) / 30 AS sx, y0, sy FROM ext),
    g AS (SELECT (x - x0) / sx AS gx, (y - y0) / sy AS gy FROM pts, box),
    d AS (SELECT *, round_even(gx, 0) AS cx, round_even(gy, 0) AS cy, floor(gx) AS mx, floor(gy) AS my FROM g),
    c AS (SELECT *, pow(gx - cx, 2) + 3 * pow(gy - cy, 2) < pow(gx - mx - 0.5, 2) + 3 * pow(gy - my - 0.5, 2) AS near FROM d),
    e AS (SELECT CASE WHEN near THEN 1 ELSE 2 END AS lattice, CAST(CASE WHEN near THEN cx ELSE mx END AS INT) AS ix,
            CAST(CASE WHEN near THEN cy ELSE my END AS INT) AS iy FROM c),
    f AS (SELECT lattice, ix, iy, count(*) AS n FROM e WHERE lattice = 1 OR (ix < 30 AND iy < 17) GROUP BY ALL)
    SELECT lattice, ix, iy, round(x0 + (ix + (lattice - 1) * 0.5) * sx + 1.3717e-7, 5) AS x,
           round(y0 + (iy + (lattice - 1) * 0.5) * sy + 1.3717e-6, 4) AS y, n
    FROM f, box
    """,
    obs=True,
)
def hexbin(spark, sf_dir):
    return rounded(rounded(dist.hexbin(observations(spark, sf_dir), "quantity", "price"), 5, "x"), 4, "y")


@query(
    "mean_ci_normal",
    """
    SELECT state, strftime(last_day(ts), '%Y-%m-%d') AS month_end, count(price) AS n, round(avg(price) + 1.3717e-6, 4) AS mean,
           round(avg(price) - 1.959963984540054 * stddev_samp(price) / sqrt(count(price)) + 1.3717e-6, 4) AS low,
           round(avg(price) + 1.959963984540054 * stddev_samp(price) / sqrt(count(price)) + 1.3717e-6, 4) AS high
    FROM obs GROUP BY 1, 2
    """,
    obs=True,
)
def mean_ci_normal(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("month_end", F.last_day("ts"))
    return rounded(with_days(dist.mean_ci_by(obs, ["state", "month_end"], "price"), "month_end"), 4, "mean", "low", "high")


@query(
    "mean_ci_bootstrap_bounds",
    """
    SELECT location, year(ts) AS year, count(price) AS n, round(avg(price) + 1.3717e-6, 4) AS mean,
           TRUE AS ordered, CASE WHEN count(price) >= 30 THEN TRUE END AS as_wide_as_normal
    FROM obs GROUP BY 1, 2 HAVING count(price) > 1
    """,
    obs=True,
)
def mean_ci_bootstrap_bounds(spark, sf_dir):
    """The bootstrap's intervals hold their mean, and those of 30 values or more are about as wide as the normal ones."""
    obs = observations(spark, sf_dir).withColumn("year", F.year("ts"))
    keys = ["location", "year"]
    normal = dist.mean_ci_by(obs, keys, "price").select(*keys, (F.col("high") - F.col("low")).alias("width"))
    joined = dist.mean_ci_by(obs, keys, "price", method="bootstrap").where("n > 1").join(normal, keys)
    wide = F.when(F.col("n") >= 30, ((F.col("high") - F.col("low")) / F.col("width")).between(0.7, 1.4))
    ordered = F.col("mean").between(F.col("low"), F.col("high"))
    return rounded(joined.select(*keys, "n", "mean", ordered.alias("ordered"), wide.alias("as_wide_as_normal")), 4, "mean")


@query("mean_ci_bootstrap")
def mean_ci_bootstrap(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("year", F.year("ts"))
    return dist.mean_ci_by(obs, ["location", "year"], "price", method="bootstrap")


@query(
    "grid_intensity",
    """
    SELECT CAST(floor((8.0 + n_nationkey * 1.25) / 5) AS BIGINT) AS lat_cell,
           CAST(floor((68 + (n_nationkey * 7) % 28) / 5.0) AS BIGINT) AS lon_cell,
           round(sum(price) + 1.3717e-4, 2) AS intensity, count(price) AS n
    FROM obs JOIN nation ON location = n_name WHERE n_nationkey <> 7 GROUP BY 1, 2
    """,
    obs=True,
)
def grid_intensity(spark, sf_dir):
    cells = dist.grid_intensity(observations(spark, sf_dir), coordinates(spark, sf_dir), "location", "price", 5.0)
    return rounded(as_long(cells, "n"), 2, "intensity")


# --- text ------------------------------------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in words.STOP_WORDS)
_WORDS = r"""
    docs AS (SELECT list_filter(
        list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_'']*'),
                       lambda w: regexp_replace(w, '''s$', '')),
        lambda w: NOT regexp_matches(w, '^\p{Nd}+$')) AS ws FROM documents WHERE text IS NOT NULL)"""
_COUNTS = f"""
    toks AS (SELECT unnest(ws) AS word FROM docs),
    uni AS (SELECT word, count(*) AS n FROM toks WHERE word NOT IN ({_STOP}) GROUP BY word)"""
_PAIRS = f"""
    bi AS (SELECT first, second, count(*) AS n
           FROM (SELECT unnest(ws[:-2]) AS first, unnest(ws[2:]) AS second FROM docs WHERE len(ws) > 1)
           WHERE first NOT IN ({_STOP}) AND second NOT IN ({_STOP}) GROUP BY ALL)"""
_SCORES = """
    k AS (SELECT first, second, bi.n AS n, CAST(bi.n AS DOUBLE) AS c12, CAST(a.n AS DOUBLE) AS c1, CAST(b.n AS DOUBLE) AS c2,
            CAST((SELECT sum(n) FROM uni) AS DOUBLE) AS t
          FROM bi JOIN uni a ON a.word = first JOIN uni b ON b.word = second),
    p AS (SELECT *, c2 / t AS p0, c12 / c1 AS p1, (c2 - c12) / (t - c1) AS p2 FROM k),
    s AS (SELECT first, second, n, -2 * (
            ln(greatest(p0, 1e-10)) * c12 + ln(greatest(1 - p0, 1e-10)) * (c1 - c12)
          + ln(greatest(p0, 1e-10)) * (c2 - c12) + ln(greatest(1 - p0, 1e-10)) * (t - c1 - c2 + c12)
          - ln(greatest(p1, 1e-10)) * c12 - ln(greatest(1 - p1, 1e-10)) * (c1 - c12)
          - ln(greatest(p2, 1e-10)) * (c2 - c12) - ln(greatest(1 - p2, 1e-10)) * (t - c1 - c2 + c12)) AS score FROM p)"""


@query("token_counts", f"WITH {_WORDS}, {_COUNTS} SELECT word, n FROM uni")
def token_counts(spark, sf_dir):
    return words.token_counts(table(spark, sf_dir, "documents"), "text")


@query(
    "token_counts_merged",
    f"""
    WITH {_WORDS}, {_COUNTS}
    SELECT coalesce(s.word, u.word) AS word, CAST(sum(u.n) AS BIGINT) AS n FROM uni u
    LEFT JOIN uni s ON u.word LIKE '%s' AND u.word NOT LIKE '%ss' AND s.word = left(u.word, length(u.word) - 1)
    GROUP BY 1
    """,
)
def token_counts_merged(spark, sf_dir):
    return words.token_counts(table(spark, sf_dir, "documents"), "text", merge_plurals=True)


@query(
    "collocations",
    f"WITH {_WORDS}, {_COUNTS}, {_PAIRS}, {_SCORES} SELECT first, second, n, round(score + 1.3717e-5, 3) AS score FROM s WHERE score > 30",
)
def collocations(spark, sf_dir):
    return rounded(words.collocations(table(spark, sf_dir, "documents"), "text"), 3, "score")


@query(
    "phrase_counts",
    f"""
    WITH {_WORDS}, {_COUNTS}, {_PAIRS}, {_SCORES}, found AS (SELECT * FROM s WHERE score > 30),
    used AS (SELECT first AS word, -n AS n FROM found UNION ALL SELECT second, -n FROM found
             UNION ALL SELECT word, n FROM uni)
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM used GROUP BY word HAVING sum(n) > 0
    UNION ALL SELECT first || ' ' || second, n FROM found
    """,
)
def phrase_counts(spark, sf_dir):
    return words.phrase_counts(table(spark, sf_dir, "documents"), "text")


@query(
    "phrase_counts_merged",
    f"""
    WITH {_WORDS}, {_COUNTS.replace("uni AS", "raw_uni AS")}, {_PAIRS.replace("bi AS", "raw_bi AS")},
    plural AS (SELECT u.word, s.word AS base FROM raw_uni u JOIN raw_uni s
               ON u.word LIKE '%s' AND u.word NOT LIKE '%ss' AND s.word = left(u.word, length(u.word) - 1)),
    uni AS (SELECT coalesce(base, r.word) AS word, sum(n) AS n FROM raw_uni r LEFT JOIN plural p ON p.word = r.word GROUP BY 1),
    bi AS (SELECT coalesce(p.base, first) AS first, coalesce(q.base, second) AS second, CAST(sum(n) AS BIGINT) AS n
           FROM raw_bi LEFT JOIN plural p ON p.word = first LEFT JOIN plural q ON q.word = second GROUP BY 1, 2),
    {_SCORES}, found AS (SELECT * FROM s WHERE score > 30),
    used AS (SELECT first AS word, -n AS n FROM found UNION ALL SELECT second, -n FROM found
             UNION ALL SELECT word, n FROM uni)
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM used GROUP BY word HAVING sum(n) > 0
    UNION ALL SELECT first || ' ' || second, n FROM found
    """,
)
def phrase_counts_merged(spark, sf_dir):
    return words.phrase_counts(table(spark, sf_dir, "documents"), "text", merge_plurals=True)


@query(
    "place_words",
    """
    WITH docs AS (SELECT regexp_extract_all(lower(n_name), '[\\p{L}\\p{N}_]+') AS ws
                  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    toks AS (SELECT unnest(ws) AS word FROM docs)
    SELECT word, count(*) AS n FROM toks GROUP BY word
    """,
)
def place_words(spark, sf_dir):
    """Words of the place names, one occurrence per observation."""
    return words.token_counts(observations(spark, sf_dir), "location")
