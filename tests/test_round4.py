"""Bootstrap weights, and word pairs that are scored once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugework.operators import distributions as dist
from gaugework.operators import text
from tests.conftest import rows


@pytest.mark.parametrize("mean", [1, 3, 60, 256, 300])
def test_poisson_weights(mean):
    weights = dist._poisson(np.random.default_rng(4), mean, (401, 1001), {})
    assert weights.shape == (401, 1001) and weights.dtype == float
    found = np.bincount(weights.astype(int).ravel(), minlength=2 * mean + 20)
    wanted = weights.size * np.array([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(len(found))])
    often = wanted > 20
    chi = ((found - wanted)[often] ** 2 / wanted[often]).sum()
    assert abs(chi - often.sum()) < 6 * math.sqrt(2 * often.sum()) and found[~often].sum() < 200


def test_blocks_do_not_depend_on_parts():
    df = pd.DataFrame({"x": range(1000)})
    for cuts in ([0, 1000], [0, 1, 300, 300, 812, 1000]):
        blocks = list(dist._blocks((df.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), 256))
        assert [len(b) for b in blocks] == [256, 256, 256, 232] and pd.concat(blocks).equals(df)
    assert list(dist._blocks(iter([df.iloc[:0]]), 256)) == []


def test_bootstrap_of_many_distinct_values(spark):
    """A stream serves a block of values; the result stays the same from any partitions and batches."""
    df = spark.range(60_000).select(F.lit("k").alias("k"), (F.sqrt("id") + F.col("id") / 7).alias("v"))
    df = df.unionByName(df.limit(500))
    made = [dist.mean_ci_by(df.repartition(n), ["k"], "v", "bootstrap").first() for n in (1, 5)]
    normal = dist.mean_ci_by(df, ["k"], "v").first()
    assert made[0]["low"] == pytest.approx(made[1]["low"]) and made[0]["high"] == pytest.approx(made[1]["high"])
    assert abs((made[0]["high"] - made[0]["low"]) / (normal["high"] - normal["low"]) - 1) < 0.15


def test_pairs_are_scored_once(spark):
    """The phrases read written tables: no join is left for every use of the pairs to run again."""
    df = spark.createDataFrame([("red apple",)] * 40 + [("red apples it's green",)] * 30 + [("the end",), (None,), ("",)], "t string")
    for merged in (False, True):
        out = text.phrase_counts(df, "t", threshold=1.0, merge_plurals=merged)
        shown = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in shown and dict(rows(out))["green"] == 30


def test_words_of_long_and_foreign_runs(spark):
    long = "é" * 300_000
    texts = [f"It's {long} O'Neil's x''y 42 ٤٢ 4a _b' ''q été's", None, "'"]
    got = rows(spark.createDataFrame([(t,) for t in texts], "t string").select(text.words_of(F.col("t"))))
    assert got == sorted([(["it", long, "o'neil", "x''y", "4a", "_b'", "q", "été"],), (None,), ([],)], key=repr)
