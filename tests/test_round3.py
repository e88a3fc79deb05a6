"""Sources, scopes and scan counts."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from gaugework import session
from gaugework.operators import aggregates as agg
from gaugework.operators import distributions as dist
from gaugework.operators import filters, text
from gaugework.operators.ward import ward_linkage
from gaugework.plans.fixtures import MEASURES, observations
from gaugework.sources import malformed_lines, read_observations, read_table, write_table
from tests.conftest import SMALL, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_malformed_lines(spark, tmp_path):
    lines = ['x,y,"the, z"', "1,2,3", "1,2", "1,2,3,4", '"a ""q"" b",c,"d,e"', 'a,b,"un', 'a,"b" c,d', 'a,b"c,d', ",,", '"a,b,c', "", 'é,"",""""', '"' + "long " * 20_000 + '",2,3']
    (tmp_path / "a.csv").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "b.csv").write_bytes((lines[0] + "\n7,8\n").encode("latin-1"))
    got = rows(malformed_lines(spark, str(tmp_path)))
    expected = [("short", "1,2"), ("short", "7,8"), ("long", "1,2,3,4"), ("quotes", 'a,b,"un'), ("quotes", 'a,"b" c,d'), ("quotes", 'a,b"c,d'), ("quotes", '"a,b,c')]
    assert got == sorted(expected, key=repr)
    assert read_observations(spark, str(tmp_path)).count() == 12


def test_yearly_layout_is_pruned(spark, tmp_path):
    obs = observations(spark, SMALL).select("ts", "price")
    write_table(obs, str(tmp_path / "years"), "ts")
    picked = read_table(spark, str(tmp_path / "years")).where("year = 1996")
    shown = plan(picked)
    assert "PartitionFilters: [isnotnull(year" in shown and picked.count() == obs.where(F.year("ts") == 1996).count()


def test_scope_lets_go(spark, obs):
    folder = session.shared_dir(spark).removeprefix("file://")
    profile = agg.profile_means(obs, ["location"], MEASURES).persist()
    profile.count()
    kept, written = spark.sparkContext._jsc.getPersistentRDDs().size(), set(os.listdir(folder))
    with session.scope(spark) as held:
        boxes = dist.box_stats(obs, ["price"], ["state"]).count()
        merges = ward_linkage(profile, "location", MEASURES).collect()
        assert boxes == 5 and merges and held.frames and held.paths
        with session.scope(spark) as inner:
            session.settle(spark.range(3))
        assert len(inner.frames) == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() > kept
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept and set(os.listdir(folder)) == written
    assert not session._SCOPES


def test_periods_share_a_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(400).selectExpr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS ts", "id").write.parquet(path)
    df = spark.read.parquet(path)
    periods = {"week": (7, "days"), "month": (1, "month"), "year": (1, "year")}
    tagged = filters.last_periods(df, "ts", periods).groupBy("period").count()
    assert dict(rows(tagged)) == {name: filters.last_period(df, "ts", *p).count() for name, p in periods.items()}
    tagged.collect()
    final = plan(tagged)
    final = final[: final.rindex("== Initial Plan ==")]
    # One maximum for three periods; every other use of it is a reference.
    assert len(set(re.findall(r"- Subquery subquery#\d+", final))) == 1 and "- ReusedSubquery Subquery" in final


def test_hierarchy_reads_its_leaves_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("concat('a', id % 2) AS p", "concat('b', id % 5) AS q", "CAST(id AS DOUBLE) AS v").write.parquet(path)
    with session.scope(spark):
        tree = agg.hierarchy_sum(spark.read.parquet(path), ["p", "q"], ["v"])
        shown = plan(tree)
        # Nodes, parents and the total read the kept leaves; the file stands inside them only.
        assert shown.count("InMemoryTableScan") == 3 and shown.count("InMemoryRelation") == 3
        assert shown.count("FileScan parquet") % 3 == 0 and tree.where("level = 1").agg(F.sum("share")).first()[0] == 1.0
        assert tree.where("level = 1").agg(F.sum("value")).first()[0] == 1225.0


def test_plural_pairs(spark):
    lines = ["red apple"] * 40 + ["red apples"] * 30 + ["reds apple"] * 5 + ["glass"] * 3 + [None, ""]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    got = dict(rows(text.phrase_counts(df, "t", merge_plurals=True, threshold=1.0)))
    assert got == {"red apple": 75, "glass": 3}
    apart = dict(rows(text.phrase_counts(df, "t", threshold=1.0)))
    assert "red apples" in apart or "apples" in apart


def test_describe_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (3.0, None, 2.0), (2.0, None, None)], "a double, b double, c double")
    got = {r["measure"]: r for r in agg.describe(df, ["a", "b", "c"]).collect()}
    assert tuple(got["a"])[1:] == (3, 2.0, 1.0, 1.0, 1.5, 2.0, 2.5, 3.0)
    assert tuple(got["b"])[1:] == (0,) + (None,) * 7
    assert tuple(got["c"])[1:] == (1, 2.0, None, 2.0, 2.0, 2.0, 2.0, 2.0)
    rough = {r["measure"]: r for r in agg.describe(df, ["a", "b"], approximate=True).collect()}
    assert rough["a"]["q50"] == 2.0 and rough["b"]["count"] == 0 and rough["b"]["q50"] is None
    none = agg.describe(df.limit(0), ["a"]).collect()
    assert [tuple(r)[1:] for r in none] == [(0,) + (None,) * 7]
    boxes = {r["measure"]: r for r in dist.box_stats(df, ["a", "b"]).collect()}
    assert boxes["a"]["outliers"] == 0 and boxes["a"]["whisker_high"] == 3.0 and "b" not in boxes
    assert dist.box_stats(df.limit(0), ["a"]).count() == 0
