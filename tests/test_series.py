from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import aggregates as agg
from gaugework.operators import arima, clustering, ward, windows
from gaugework.operators.arima import arima_111, arima_forecast, fit_arma_11
from gaugework.operators.stl import loess, stl, stl_fit
from gaugework.operators.ward import ward_linkage
from gaugework.plans.fixtures import MEASURES
from tests.conftest import rows

START = dt.datetime(2020, 1, 1)


def test_rolling_time_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    data = []
    for key, n in (("hot", 900), ("b", 60), ("c", 1)):
        for _ in range(n):
            hours = int(rng.integers(0, 24 * 200))
            data.append((key, START + dt.timedelta(hours=hours), float(rng.normal())))
    data += [("edge", START, 1.0), ("edge", START + dt.timedelta(days=30), 3.0), ("edge", START + dt.timedelta(days=59, hours=23), 5.0)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    for slices in (30, 4, 1):
        got = {(r["k"], r["t"]): r for r in windows.rolling_mean_time(df, ["k"], "t", "v", 30, slices).collect()}
        assert len(got) == len({(k, t) for k, t, _ in data})
        for key, at in got:
            inside = [v for k, t, v in data if k == key and at - dt.timedelta(days=30) < t <= at]
            assert got[key, at]["rolling_mean"] == pytest.approx(np.mean(inside))
            assert got[key, at]["points"] == len(inside)
    assert windows.rolling_mean_time(df, ["k"], "t", "v", 30, per_row=True).count() == len(data)
    with pytest.raises(ValueError):
        windows.rolling_mean_time(df, ["k"], "t", "v", 30, 7_000_011)


def months(n, skip=()):
    return [dt.datetime(2000 + i // 12, i % 12 + 1, 15) for i in range(n) if i not in skip]


def test_calendar_and_fill(spark):
    data = [("a", t, float(i)) for i, t in enumerate(months(36, (4, 5, 19)))]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    monthly = agg.monthly_mean(df, ["k"], "t", ["v"])
    open_ = windows.complete_months(monthly, ["k"], fill=False)
    assert open_.count() == 36 and open_.where("value is null").count() == 3
    full = [r["value"] for r in windows.complete_months(monthly, ["k"]).orderBy("month_end").collect()]
    assert full[3:7] == [3.0, 3.0, 3.0, 4.0]


def test_fill_backward_at_the_start(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "k string, o int, value double")
    assert rows(windows.fill_both_ways(df, ["k"], "o")) == [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None)]


def test_rolling_rows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(40)], "k string, o int, value double")
    got = {r["o"]: r for r in windows.rolling_mean_rows(df, ["k"], "o").collect()}
    assert got[0]["mean_7"] == 0 and got[39]["mean_7"] == 36 and got[39]["mean_30"] == 24.5


@pytest.mark.parametrize("n,kept", [(30, 0), (31, 31)])
def test_rolling_corr_gates(spark, n, kept):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.normal(size=n)
    data = [("x", t, float(p), float(q)) for t, p, q in zip(months(n), a, b, strict=True)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, a double, b double")
    got = windows.rolling_corr(df, ["k"], "t", "a", "b").orderBy("month_end").collect()
    assert len(got) == kept
    if kept:
        assert got[8]["rolling_corr"] is None
        assert got[9]["rolling_corr"] == pytest.approx(np.corrcoef(a[:10], b[:10])[0, 1])
        assert got[30]["rolling_corr"] == pytest.approx(np.corrcoef(a[1:], b[1:])[0, 1])


def test_spikes_of_constant_series(spark):
    data = [("c", 2.0)] * 20 + [("s", 0.0)] * 30 + [("s", 50.0), ("one", 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = windows.zscore_spikes(df, ["k"], "v")
    assert got.count() == len(data)
    assert rows(got.where("is_spike"), "k", "v") == [("s", 50.0)]


# --- STL -------------------------------------------------------------------------------


def direct_loess(y, span, weights, at):
    """Textbook weighted least squares at one position."""
    n = len(y)
    x = np.arange(1, n + 1)
    order = np.argsort(np.abs(x - at), kind="stable")
    reach = np.abs(x - at)[order[min(span, n) - 1]] + max(0, (span - n) // 2)
    d = np.abs(x - at) / reach
    w = np.where(d < 1, (1 - np.minimum(d, 1) ** 3) ** 3, 0) * weights
    slope, level = np.polyfit(x - at, y, 1, w=np.sqrt(w))
    return level


def test_loess_is_weighted_least_squares():
    rng = np.random.default_rng(2)
    y, w = rng.normal(size=41).cumsum(), rng.uniform(0.5, 1, 41)
    at = np.array([0, 1, 7, 20, 36, 41, 42], dtype=float)
    got = loess(y, 13, w, at)
    assert got == pytest.approx([direct_loess(y, 13, w, a) for a in at], abs=1e-9)


def test_stl_recovers_components():
    t = np.arange(120)
    season = 5 * np.sin(2 * np.pi * t / 12)
    y = 0.3 * t + season + np.random.default_rng(4).normal(0, 0.2, 120)
    y[[30, 77]] += 25
    trend, seasonal = stl_fit(y, 12, 13, True)
    assert np.abs(trend - 0.3 * t).max() < 1 and np.abs(seasonal - season).max() < 1
    rest = y - trend - seasonal
    assert set(np.argsort(-np.abs(rest))[:2]) == {30, 77} and rest[30] == pytest.approx(25, abs=1)
    line = 2.0 + 0.5 * t
    trend, seasonal = stl_fit(line, 12, 13, True)
    assert trend + seasonal == pytest.approx(line, abs=1e-6)


def direct_stl(y, period, seasonal, robust):
    """The decomposition point by point: every smooth value is one weighted line."""
    n = len(y)
    odd = lambda v: int(np.ceil(v)) + (int(np.ceil(v)) + 1) % 2
    span_t, span_l = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period)
    w, trend, season = np.ones(n), np.zeros(n), np.zeros(n)
    for lap in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            cycle = {}
            for phase in range(period):
                places = list(range(phase, n, period))
                sub, subw = np.array([y[i] - trend[i] for i in places]), np.array([w[i] for i in places])
                for k in range(len(places) + 2):
                    cycle[phase + (k - 1) * period] = direct_loess(sub, seasonal, subw, float(k))
            c = np.array([cycle[i] for i in range(-period, n + period)])
            for width in (period, period, 3):
                c = np.array([c[i : i + width].sum() / width for i in range(len(c) - width + 1)])
            low = np.array([direct_loess(c, span_l, np.ones(n), float(i + 1)) for i in range(n)])
            season = np.array([cycle[i] for i in range(n)]) - low
            trend = np.array([direct_loess(y - season, span_t, w, float(i + 1)) for i in range(n)])
        off = np.abs(y - season - trend) / (6 * np.median(np.abs(y - season - trend)))
        w = np.array([1.0 if u <= 0.001 else 0.0 if u > 0.999 else (1 - u * u) ** 2 for u in off])
    return trend, season


@pytest.mark.parametrize("robust", [False, True])
@pytest.mark.parametrize("n", [26, 41, 60])
def test_stl_equals_its_slow_form(n, robust):
    rng = np.random.default_rng(n)
    t = np.arange(n)
    y = 0.1 * t + 3 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, n) + 10 * (rng.random(n) < 0.05)
    trend, season = stl_fit(y, 12, 13, robust)
    slow_trend, slow_season = direct_stl(y, 12, 13, robust)
    assert trend == pytest.approx(slow_trend, abs=1e-6) and season == pytest.approx(slow_season, abs=1e-6)


@pytest.mark.parametrize("noise", [0.0, 1e-14, 1e-10])
@pytest.mark.parametrize("n", [25, 60, 120, 300])
def test_stl_keeps_lines_and_constants(n, noise):
    rng = np.random.default_rng(n)
    for y in (2.0 + 0.5 * np.arange(n), np.full(n, 3.0)):
        noisy = y + rng.normal(0, noise, n)
        trend, seasonal = stl_fit(noisy, 12, 13, True)
        assert np.abs(trend + seasonal - noisy).max() < 1e-9 * np.abs(y).max()


def test_stl_gates_and_identity(spark):
    data = [("a", t, float(i % 12 + i)) for i, t in enumerate(months(24))]
    data += [("b", t, float(i % 12 + i * 0.5)) for i, t in enumerate(months(25))]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    got = stl(df, ["k"], "t", ["v"])
    assert rows(got.groupBy("k", "status").count()) == [("a", "too few points", 24), ("b", "ok", 25)]
    assert got.where("k = 'a' and trend is not null").count() == 0
    off = got.where("k = 'b'").select(F.max(F.abs(F.col("observed") - F.col("trend") - F.col("seasonal") - F.col("resid"))))
    assert off.collect()[0][0] < 1e-9


# --- ARIMA -----------------------------------------------------------------------------


def simulate(phi, theta, n, seed):
    e = np.random.default_rng(seed).normal(size=n + 1)
    w = np.zeros(n)
    for i in range(n):
        w[i] = (phi * w[i - 1] if i else 0) + e[i + 1] + theta * e[i]
    return w


@pytest.mark.parametrize("phi,theta", [(0.7, 0.3), (-0.5, 0.2), (0.3, -0.8)])
def test_arma_recovers_parameters(phi, theta):
    got = fit_arma_11(simulate(phi, theta, 4000, 9))
    assert got[:2] == pytest.approx((phi, theta), abs=0.08) and got[2] == pytest.approx(1, abs=0.08)


def test_arma_likelihood_is_the_gaussian_one():
    """The concentrated likelihood equals that of the full covariance matrix."""
    from gaugework.operators.arima import _innovations

    w, phi, theta = simulate(0.6, 0.4, 30, 2), 0.5, 0.3
    psi = np.concatenate([[1], (phi + theta) * phi ** np.arange(400)])
    gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(30)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(30), np.arange(30)))]
    squares, logs, _ = _innovations(w, np.array([phi]), np.array([theta]))
    assert squares[0] == pytest.approx(w @ np.linalg.solve(cov, w)) and logs[0] == pytest.approx(np.linalg.slogdet(cov)[1])


def narrowed_grid(w):
    """The smallest loss that a grid narrowed around its best point finds."""
    middle, half, least = np.zeros(2), 3.0, np.inf
    for _ in range(14):
        side = np.linspace(-half, half, 25)
        at = np.stack(np.meshgrid(middle[0] + side, middle[1] + side, indexing="ij"), axis=-1).reshape(-1, 2)
        loss = arima._loss(w, at)
        middle, half, least = at[np.argmin(loss)], half / 4, min(least, loss.min())
    return least


def test_likelihood_is_never_below_a_fine_grids():
    rng = np.random.default_rng(23)
    for case in range(500):
        phi, theta = rng.uniform(-0.98, 0.98, 2)
        if case % 4 == 0:
            theta = -phi + rng.normal(0, 0.02)
        w = simulate(phi, theta, int(rng.integers(24, 90)), case)
        if case % 5 == 0:
            w[rng.integers(len(w))] += 15
        got = np.array(fit_arma_11(w)[:2])
        mine = arima._loss(w, np.arctanh(np.clip(got, -1 + 1e-15, 1 - 1e-15))[None])[0]
        assert mine <= narrowed_grid(w) + 1e-9, (case, phi, theta)


def test_forecast_dates_and_gate(spark):
    rng = np.random.default_rng(8)
    data = [(k, t, float(v)) for k, n in (("a", 24), ("b", 25)) for t, v in zip(months(n), rng.normal(size=n).cumsum(), strict=True)]
    data += [("flat", t, 2.0) for t in months(30)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    got = arima_forecast(df, ["k"], "t", ["v"], steps=6)
    assert rows(got.where("k = 'a'"), "step", "status") == [(0, "too few points")]
    b = got.where("k = 'b'").orderBy("step").collect()
    assert [r["month_end"] for r in b[:2]] == [dt.date(2002, 2, 28), dt.date(2002, 3, 31)] and len(b) == 6
    spread = [r["std_error"] for r in b]
    assert spread == sorted(spread)
    assert rows(got.where("k = 'flat'"), "forecast")[0] == (2.0,)
    with pytest.raises(ValueError):
        arima_111(np.array([1.0, np.nan, 2.0]), 3)


# --- clustering ------------------------------------------------------------------------


def grouped(spark, n=9):
    rng = np.random.default_rng(6)
    data = []
    for i in range(n):
        level = (i % 3) * 100
        data += [(f"e{i}", t, float(level + 10 * np.sin(j) * (i % 3) + rng.normal())) for j, t in enumerate(months(14))]
    return spark.createDataFrame(data, "e string, t timestamp_ntz, v double")


def test_kmeans_finds_the_groups(spark):
    matrix = clustering.feature_matrix(grouped(spark), ["e"], "t", ["v"])
    assert {len(r["features"]) for r in matrix.collect()} == {14}
    got = {r["e"]: r["cluster"] for r in clustering.kmeans(matrix, ["e"], k=3, restarts=4).collect()}
    # Clusters are numbered by their smallest member.
    assert got == {f"e{i}": i % 3 for i in range(9)}
    trends = clustering.cluster_trends(clustering.kmeans(matrix, ["e"], k=3, restarts=2))
    assert trends.count() == 3 * 14
    everyone = clustering.kmeans(matrix, ["e"], k=50, restarts=1)
    assert everyone.select("cluster").distinct().count() == 9
    assert clustering.kmeans(matrix.limit(1), ["e"]).count() == 0


def test_kmeans_does_not_see_partitions(spark):
    """The same clusters from 1, 4 and 64 partitions; every row lies nearest to its own cluster's mean."""
    rng = np.random.default_rng(17)
    data = [(f"e{i:03d}", "v", list(map(float, rng.normal(size=6) + 2 * (i % 4)))) for i in range(150)]
    data += [("same1", "v", [1.0] * 6), ("same2", "v", [1.0] * 6), ("same2", "w", [1.0] * 6)]
    months_ = [dt.date(2020, m, 28) for m in range(1, 7)]
    df = spark.createDataFrame([(*r, months_) for r in data], "e string, measure string, features array<double>, months array<date>")
    made = [rows(clustering.kmeans(df.repartition(n), ["e"], k=6), "e", "measure", "cluster") for n in (1, 4, 64)]
    assert made[0] == made[1] == made[2] and len(made[0]) == 153 and {r[2] for r in made[0]} == set(range(6))
    x = np.array([r[2] for r in sorted(data)])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    label = np.array([r[2] for r in made[0]])
    means = np.array([z[label == c].mean(axis=0) for c in range(6)])
    assert (((z[:, None] - means) ** 2).sum(axis=2).argmin(axis=1) == label).all()
    cost = ((z - means[label]) ** 2).sum()
    one = clustering.kmeans(df, ["e"], k=6, restarts=1)
    single = np.array([r[2] for r in rows(one, "e", "measure", "cluster")])
    assert cost <= sum(((z[single == c] - z[single == c].mean(axis=0)) ** 2).sum() for c in range(6)) + 1e-6


def test_feature_matrix_fills_with_zero(spark):
    data = [("a", months(3)[0], 1.0), ("a", months(3)[2], 3.0), ("b", months(3)[1], 5.0)]
    df = spark.createDataFrame(data, "e string, t timestamp_ntz, v double")
    matrix = clustering.feature_matrix(df, ["e"], "t", ["v"])
    assert {r["e"]: r["features"] for r in matrix.collect()} == {"a": [1.0, 0.0, 3.0], "b": [0.0, 5.0, 0.0]}
    z = {r["e"]: r["scaled"] for r in clustering.standardize(matrix).collect()}
    assert z["a"] == pytest.approx([1, -1, 1]) and z["b"] == pytest.approx([-1, 1, -1])
    flat = clustering.standardize(matrix.limit(1)).collect()[0]
    assert flat["scaled"] == [0.0, 0.0, 0.0]


def naive_ward(x):
    live = {i: (1, x[i]) for i in range(len(x))}
    heights, members = [], {i: frozenset([i]) for i in live}
    sets = []
    while len(live) > 1:
        best = None
        for i in live:
            for j in live:
                if i < j:
                    (a, p), (b, q) = live[i], live[j]
                    h = np.sqrt(2 * a * b / (a + b)) * np.linalg.norm(p - q)
                    if best is None or h < best[0]:
                        best = (h, i, j)
        h, i, j = best
        (a, p), (b, q) = live.pop(i), live.pop(j)
        live[i] = (a + b, (a * p + b * q) / (a + b))
        members[i] = members[i] | members[j]
        heights.append(h)
        sets.append(members[i])
    return heights, sets


@pytest.mark.parametrize("block", [500, 5, 2])
def test_ward_equals_greedy_merging(spark, block):
    x = np.random.default_rng(11).normal(size=(17, 3))
    df = spark.createDataFrame([(f"n{i:02d}", *map(float, p)) for i, p in enumerate(x)], "k string, a double, b double, c double")
    got = ward_linkage(df, "k", ["a", "b", "c"], block).orderBy("step").collect()
    heights, sets = naive_ward(x)
    assert [r["height"] for r in got] == pytest.approx(heights)
    assert [r["step"] for r in got] == list(range(16))
    members = {i: frozenset([i]) for i in range(17)}
    for r in got:
        members[17 + r["step"]] = members[r["left"]] | members[r["right"]]
        assert r["size"] == len(members[17 + r["step"]])
    assert {members[17 + r["step"]] for r in got} == set(sets)


def test_ward_of_ties_and_of_one(spark):
    df = spark.createDataFrame([(f"n{i}", 0.0) for i in range(6)], "k string, a double")
    got = ward_linkage(df, "k", ["a"]).orderBy("step").collect()
    assert [r["height"] for r in got] == [0.0] * 5 and got[-1]["size"] == 6
    assert ward_linkage(df.limit(1), "k", ["a"]).count() == 0


def test_rolling_per_row_asks_for_windows(spark):
    """A row without a value gets the mean of those before it, as a time window over rows does."""
    rng = np.random.default_rng(12)
    data = []
    for key, n in (("a", 400), ("b", 40)):
        for _ in range(n):
            at = START + dt.timedelta(hours=int(rng.integers(0, 24 * 120)))
            data.append((key, at, None if rng.random() < 0.4 else float(rng.normal())))
    data += [("c", START, None), (None, START, 1.0), ("d", None, 2.0), ("e", START, float("nan")), ("e", START + dt.timedelta(days=2), 4.0)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    got = windows.rolling_mean_time(df, ["k"], "t", "v", days=10, per_row=True).collect()
    assert len(got) == len(data)
    for r in got:
        if r["k"] is None or r["t"] is None:
            assert r["rolling_mean"] is None
            continue
        inside = [v for k, t, v in data if k == r["k"] and t is not None and r["t"] - dt.timedelta(days=10) < t <= r["t"] and v is not None and v == v]
        assert r["points"] == len(inside)
        assert r["rolling_mean"] == (pytest.approx(np.mean(inside)) if inside else None)


def test_ward_on_a_grid_of_ties(spark):
    """Equal distances everywhere, several blocks: heights as greedy merging, sizes add up, the last merge holds all."""
    x = [(float(i % 6), float(i // 6)) for i in range(36)] * 2
    df = spark.createDataFrame([(f"n{i:02d}", *p) for i, p in enumerate(x)], "k string, a double, b double")
    got = ward_linkage(df, "k", ["a", "b"], 7).orderBy("step").collect()
    heights = [r["height"] for r in got]
    assert len(got) == 71 and heights == sorted(heights) and heights[:36] == [0.0] * 36 and got[-1]["size"] == 72
    total = 2 * sum(np.var([p[d] for p in x]) * 72 for d in range(2))
    assert sum(h * h for h in heights) == pytest.approx(total)
    size = {i: 1 for i in range(72)}
    for r in got:
        size[72 + r["step"]] = size.pop(r["left"]) + size.pop(r["right"])
        assert r["size"] == size[72 + r["step"]]


def test_ward_compares_few_pairs(spark):
    """20,000 entities: inside blocks and with the blocks that are asked, a small part of all pairs."""
    n = 20_000
    made = spark.range(n).selectExpr("id", "1L AS size", "array(rand(3) * 100, rand(4) * 30) AS centre", "0.0D AS level")
    state = ward._placed(made.persist(), n, 200).persist()
    boxes, count = ward._boxes(state, 2)
    assert count == n and len(boxes.leaf) > 64
    left = ward._inside(state, boxes)
    sizes = state.groupBy("leaf").agg(F.count("*").alias("members")).persist()
    inside = sizes.agg(F.sum(F.col("members") * F.col("members"))).first()[0]
    asked = left.where("gone IS NULL").select(F.explode("ask").alias("leaf")).join(sizes, "leaf").agg(F.sum("members")).first()[0]
    assert inside + asked < n * n / 20
    assert left.where("gone IS NOT NULL").count() > n / 3


def test_models_on_observations(obs):
    assert stl(obs, ["state"], "ts", MEASURES, gaps="fill").where("status = 'ok'").count() > 0
