from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import aggregates as agg
from gaugework.operators import filters, joins, ranking
from gaugework.operators.quantiles import quantiles
from gaugework.plans.fixtures import MEASURES
from tests.conftest import rows

KEYED = "k string, g string, x double, y double"


@pytest.fixture(scope="module")
def keyed(spark):
    data = [("a", "p", 1.0, 5.0), ("a", "q", 3.0, None), (None, "p", 9.0, 1.0), ("b", None, float("nan"), 2.0)]
    return spark.createDataFrame(data, KEYED)


def test_null_keys_are_left_out_but_counted(keyed):
    assert rows(agg.mean_by(keyed, ["k"], ["x", "y"])) == [("a", 2.0, 5.0), ("b", None, 2.0)]
    assert rows(agg.value_counts(keyed, "k")) == [("a", 2), ("b", 1), (None, 1)]
    assert rows(agg.value_counts(keyed, "k", keep_null=False)) == [("a", 2), ("b", 1)]


def test_kpi_skips_nan(keyed):
    got = {r["measure"]: r for r in agg.kpi(keyed, ["x", "y"]).collect()}
    assert got["x"]["count"] == 3 and got["x"]["mean"] == pytest.approx(13 / 3) and got["x"]["max"] == 9.0


def test_missing(keyed):
    got = {r["column"]: r["missing"] for r in agg.missing_percent(keyed).collect()}
    assert got == {"k": 1, "g": 1, "x": 1, "y": 1}
    assert agg.missing_patterns(keyed, ["k", "g", "x", "y"]).count() == 4
    assert agg.missing_corr(keyed.withColumn("z", F.lit(1.0)), ["x", "y", "z"]).where("a = 'z' or b = 'z'").count() == 0


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 6.5, 7.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in agg.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "c"] is None and got["c", "c"] is None
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])


@pytest.mark.parametrize("shape", ["uniform", "ties", "heavy", "two", "one"])
def test_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(7)
    data = {
        "uniform": rng.uniform(size=5001),
        "ties": rng.integers(0, 4, 5000).astype(float),
        "heavy": np.exp(rng.normal(0, 6, 3000)),
        "two": np.array([1.0, 2.0]),
        "one": np.array([3.0]),
    }[shape]
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(data)], "x double, g int")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    # A rough sketch must cost work, never exactness.
    got = quantiles(df, ["x"], probs, accuracy=20).collect()[0]
    assert got["q"] == pytest.approx(np.quantile(data, probs), rel=1e-12)
    for r in quantiles(df, ["x"], probs, ["g"]).collect():
        assert r["q"] == pytest.approx(np.quantile(data[r["g"] :: 3], probs), rel=1e-12)
    near = quantiles(df, ["x"], (0.5,), approximate=True).collect()[0]["q"][0]
    assert near in data


def test_hierarchy_parent_is_sum_of_children(obs):
    tree = agg.hierarchy_sum(obs, ["state", "location"], MEASURES).persist()
    whole = obs.agg(*[F.sum(m) for m in MEASURES]).collect()[0]
    assert tree.where("level = 1").agg(F.sum("value")).collect()[0][0] == pytest.approx(sum(whole))
    shares = tree.groupBy("level", "state", F.when(F.col("level") == 3, F.col("location")).alias("l")).agg(F.sum("share").alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in shares.where("level > 1").collect())


def test_rank_names_is_a_dense_sorted_index(spark):
    names = [f"{a}{b}" for a in "abx" for b in range(40)] + ["a", "", "Ä", "zz"]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "n string")
    got = {r["n"]: r["index"] for r in agg.rank_names(df, "n").collect()}
    assert got == {n: i for i, n in enumerate(sorted(set(names), key=lambda s: s.encode()))}


def test_flow_nodes_put_sources_first(obs):
    edges = agg.flow_counts(obs, "state", MEASURES)
    links = agg.flow_links(edges).collect()
    assert {r["source_index"] for r in links} == set(range(5))
    assert {r["target_index"] for r in links} == {5, 6, 7, 8}
    assert max(r["width"] for r in agg.edge_width(edges).collect()) == 5.0


def test_pivots(spark, obs):
    by_month = agg.month_year_pivot(obs, "ts", "price")
    assert by_month.count() == 12 and by_month.columns == ["month", *[str(y) for y in range(1995, 2002)]]
    filled = agg.month_year_pivot(obs, "ts", "price", rows="year", fill=0.0)
    assert filled.columns[1:] == [str(m) for m in range(1, 13)]
    assert filled.where("year = 2001").select("12").collect()[0][0] == 0.0


def test_sample_is_exact_repeatable_and_partition_invariant(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    a = rows(ranking.sample_n(df.repartition(1), 100, key=["id"]))
    b = rows(ranking.sample_n(df.repartition(64), 100, key=["id"]))
    assert a == b and len(a) == 100
    assert a != rows(ranking.sample_n(df, 100, seed=1, key=["id"]))
    assert ranking.sample_n(df.limit(30), 100).count() == 30
    # A third of all rows are copies of one row.
    copies = df.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    for seed in range(4):
        assert ranking.sample_n(copies, 100, seed).count() == 100
    assert ranking.sample_n(copies, 10_000).count() == 5000
    want = df.withColumn("d", F.xxhash64(F.lit(42), "id")).orderBy("d").limit(100).select("id", "v")
    assert rows(want) == a


def test_topk_ties(spark):
    df = spark.createDataFrame([(c, 1.0) for c in "dcba"], "k string, x double")
    assert [r["k"] for r in ranking.top_means(df, "k", ["x"], 2).orderBy("rank").collect()] == ["a", "b"]
    assert rows(joins.most_frequent(df, "k", 3)) == [("a", 1), ("b", 1), ("c", 1)]
    assert joins.semi_topk(df, "k", 2).count() == 2


def test_gate_boundary(spark):
    df = spark.createDataFrame([("a", i) for i in range(24)] + [("b", i) for i in range(25)], "k string, i int")
    got = {(r["k"], r["status"]) for r in filters.gate(df, ["k"], 24).collect()}
    assert got == {("a", "too few points"), ("b", "ok")}


def test_empty_input_keeps_schema(spark, obs):
    empty = obs.where("state = 'nowhere'")
    for df in (
        agg.kpi(empty, MEASURES), agg.describe(empty, MEASURES), agg.corr_matrix(empty, MEASURES),
        agg.hierarchy_sum(empty, ["state"], MEASURES), agg.flow_links(agg.flow_counts(empty, "state", MEASURES)),
        agg.monthly_mean(empty, ["state"], "ts", MEASURES), ranking.top_means(empty, "location", MEASURES),
        ranking.facet_rows(empty, "location", "ts", MEASURES), agg.month_year_pivot(empty, "ts", "price"),
    ):
        assert df.columns
        df.collect()
    assert {r["count"] for r in agg.kpi(empty, MEASURES).collect()} == {0}


def test_results_do_not_depend_on_partitions_or_hot_keys(spark):
    """A third of the rows share one key, and half of those one value and time."""
    from gaugework.operators import distributions as dist
    from gaugework.operators import windows

    rng = np.random.default_rng(12)
    n = 3000
    hot = np.arange(n) % 3 == 0
    same = hot & (np.arange(n) % 2 == 0)
    data = [
        (
            "hot" if hot[i] else f"k{rng.integers(0, 40)}",
            1000 if same[i] else int(rng.integers(0, 90 * 24)),
            5.0 if same[i] else float(np.round(rng.gamma(2, 3), 2)),
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(data, "k string, hour int, v double")
    df = df.withColumn("t", F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, hour)"))

    def results(part):
        return {
            "quantiles": quantiles(part, ["v"], (0.25, 0.5), ["k"]),
            "histogram": dist.histogram(part, ["v"], 10, ["k"]),
            "kde": dist.kde(part, ["v"], ["k"], points=20).withColumn("density", F.round("density", 9)),
            "box": dist.box_stats(part, ["v"]),
            "rolling": windows.rolling_mean_time(part, ["k"], "t", "v", 10).withColumn(
                "rolling_mean", F.round("rolling_mean", 9)
            ),
            "spikes": windows.zscore_spikes(part, ["k"], "v").withColumn("zscore", F.round("zscore", 9)),
            "sample": ranking.sample_n(part, 50),
            "top": ranking.top_means(part, "k", ["v"], 5).withColumn("value", F.round("value", 9)),
        }

    one, many = results(df.coalesce(1)), results(df.repartition(64))
    for name in one:
        assert rows(one[name]) == rows(many[name]), name
