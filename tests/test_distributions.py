from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import distributions as dist
from gaugework.operators import text
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(10, 2, 700), rng.normal(30, 5, 300), [200.0]])
    y = rng.gamma(2, 3, len(x))
    data = [(float(a), float(b), "g" if i % 4 else "h") for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(data, "x double, y double, g string").persist()


def test_histogram_counts_sum_to_n(sample):
    x, _, df = sample
    got = dist.histogram(df, ["x"], 50).orderBy("bin").collect()
    counts, edges = np.histogram(x, 50)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["left"] for r in got] == pytest.approx(edges[:-1])
    by = dist.histogram(df, ["x", "y"], 30, ["g"])
    assert by.agg(F.sum("n")).collect()[0][0] == 2 * len(x) and by.count() == 120


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([(4.0,)] * 3, "x double")
    got = dist.histogram(df, ["x"], 10).where("n > 0").collect()
    assert [(r["bin"], r["n"]) for r in got] == [(5, 3)]
    assert rows(dist.kde(df, ["x"])) == []
    box = dist.box_stats(df, ["x"]).collect()[0]
    assert box["q1"] == box["whisker_high"] == 4.0 and box["outliers"] == 0


def test_box(sample):
    x, _, df = sample
    got = dist.box_stats(df, ["x"]).collect()[0]
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert (got["q1"], got["median"], got["q3"]) == pytest.approx((q1, q2, q3))
    assert (got["whisker_low"], got["whisker_high"]) == (inside.min(), inside.max())
    assert got["outliers"] == len(x) - len(inside) == dist.box_outliers(df, ["x"]).count()


def direct_kde(x, grid):
    h = x.std(ddof=1) * len(x) ** -0.2
    return np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi)), h


def test_kde_matches_the_direct_sum(sample):
    x, _, df = sample
    got = dist.kde(df, ["x"], cut=3.0).orderBy("point").collect()
    grid = np.array([r["x"] for r in got])
    want, h = direct_kde(x, grid)
    assert (grid[0], grid[-1]) == pytest.approx((x.min() - 3 * h, x.max() + 3 * h))
    assert np.abs(np.array([r["density"] for r in got]) - want).max() < 1e-10
    assert np.trapezoid(want, grid) == pytest.approx(1, abs=0.01)
    counted = dist.kde(df, ["x"], scale="count", bins=50).collect()
    assert len(counted) == 200 and max(r["density"] for r in counted) > 10


def test_kde_shared_grid(sample):
    x, _, df = sample
    got = dist.kde(df, ["x"], ["g"], grid="shared", pad=0.2, points=50).collect()
    for name, part in (("h", x[::4]), ("g", np.delete(x, np.arange(0, len(x), 4)))):
        mine = sorted((r["x"], r["density"]) for r in got if r["g"] == name)
        grid = np.array([m[0] for m in mine])
        span = x.max() - x.min()
        assert grid[0] == pytest.approx(x.min() - 0.2 * span)
        assert np.abs(np.array([m[1] for m in mine]) - direct_kde(part, grid)[0]).max() < 1e-10


def test_hexbin_keeps_every_point(sample):
    x, _, df = sample
    cells = dist.hexbin(df, "x", "y").collect()
    assert sum(r["n"] for r in cells) == len(x)
    # Every point lies in the cell whose centre is nearest in the stretched metric.
    assert {r["lattice"] for r in cells} == {1, 2}


def test_bootstrap_agrees_with_normal(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.normal(5, 2, 2000)] + [("b", float(v)) for v in rng.integers(0, 3, 3000)]
    df = spark.createDataFrame([*data, ("single", 1.0)], "k string, v double")
    normal = {r["k"]: r for r in dist.mean_ci_by(df, ["k"], "v").collect()}
    boot = {r["k"]: r for r in dist.mean_ci_by(df, ["k"], "v", "bootstrap", replicates=600).collect()}
    for k in "ab":
        width = normal[k]["high"] - normal[k]["low"]
        assert boot[k]["mean"] == pytest.approx(normal[k]["mean"])
        assert abs(boot[k]["low"] - normal[k]["low"]) < 0.15 * width
        assert abs(boot[k]["high"] - normal[k]["high"]) < 0.15 * width
    assert normal["single"]["low"] is None and boot["single"]["low"] is None
    again = {r["k"]: r for r in dist.mean_ci_by(df.repartition(5), ["k"], "v", "bootstrap", replicates=600).collect()}
    assert again["a"]["low"] == pytest.approx(boot["a"]["low"])


def test_bootstrap_of_a_hot_key_and_many_keys(spark):
    """Equal to the last digits from any partitions; a key's parts come as few rows; nulls have no group."""
    rng = np.random.default_rng(8)
    data = [("hot", int(y), float(v)) for y, v in zip(rng.integers(0, 2, 30_000), rng.normal(5, 2, 30_000).round(1), strict=True)]
    data += [(f"k{i % 50}", 0, float(i)) for i in range(200)] + [(None, 0, 1.0), ("nan", 0, float("nan")), ("none", 0, None)]
    df = spark.createDataFrame(data, "k string, y int, v double")
    made = [rows(dist.mean_ci_by(df.repartition(n), ["k", "y"], "v", "bootstrap", replicates=300)) for n in (1, 7)]
    assert [r[:2] for r in made[0]] == [r[:2] for r in made[1]] and len(made[0]) == 52
    assert [r[2:] for r in made[0]] == [pytest.approx(r[2:]) for r in made[1]]
    for key, _, n, mean, low, high in made[0]:
        values = np.array([v for k, y, v in data if k == key and (key != "hot" or y == _)])
        half = 1.96 * values.std(ddof=1) / np.sqrt(n)
        assert n == len(values) and mean == pytest.approx(values.mean()) and low <= mean <= high
        if key == "hot":
            assert abs((high - low) / (2 * half) - 1) < 0.2


def test_grid_intensity_drops_unknown_places(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("c", 8.0)], "p string, v double")
    places = spark.createDataFrame([("a", 10.2, -3.5), ("b", 10.9, -3.1), ("c", None, 1.0)], "p string, lat double, lon double")
    assert rows(dist.grid_intensity(df, places, "p", "v")) == [(10, -4, 7.0, 3)]


PLACES = ["New Delhi", "New Delhi", None, "New Town 42", "The town's hall", "Towns"]


def test_tokens(spark):
    df = spark.createDataFrame([(p,) for p in PLACES], "t string")
    assert dict(rows(text.token_counts(df, "t"))) == {"new": 3, "delhi": 2, "town": 2, "hall": 1, "towns": 1}
    assert dict(rows(text.token_counts(df, "t", merge_plurals=True)))["town"] == 3


def test_collocations_stay_within_a_row(spark):
    df = spark.createDataFrame([("alpha beta",)] * 60 + [("gamma the delta",)] * 60 + [("x y z",)], "t string")
    pairs = dict(((a, b), n) for a, b, n, _ in rows(text.collocations(df, "t", threshold=30.0)))
    assert pairs == {("alpha", "beta"): 60}
    phrases = dict(rows(text.phrase_counts(df, "t")))
    assert phrases["alpha beta"] == 60 and "alpha" not in phrases and phrases["gamma"] == 60
