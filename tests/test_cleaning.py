from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugework.functions.scalars import display, label, to_number
from gaugework.functions.temporal import parse_date, parse_month_code, wall_micros
from gaugework.operators import cleaning
from gaugework.operators.filters import Selection
from gaugework.plans.cleaning import clean_observations, long_form
from gaugework.sources import export_filtered, read_observations, read_table, write_csv, write_table
from tests.conftest import rows


def one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column.alias("x")).orderBy("i").select("x").collect()]


def test_month_codes(spark):
    texts = ["February - M021990", "m121990", "M11990", "M131990", "junk", "M021990 ", None, "M001990", "a - b - M31999"]
    got = one(spark, texts, parse_month_code("v"))
    assert got == [
        dt.datetime(1990, 2, 1), dt.datetime(1990, 12, 1), dt.datetime(1990, 1, 1), None, None,
        dt.datetime(1990, 2, 1), None, None, dt.datetime(1999, 3, 1),
    ]


def test_dates_are_day_first(spark):
    texts = ["01-02-1990", "1-2-1990", "31-02-1990", "1990-02-01", " 5/6/2001", "x", None]
    feb = dt.datetime(1990, 2, 1)
    assert one(spark, texts, parse_date("v")) == [feb, feb, None, feb, dt.datetime(2001, 6, 5), None, None]
    assert one(spark, ["01-02-1990"], parse_date("v", day_first=False)) == [dt.datetime(1990, 1, 2)]


def test_numbers(spark):
    texts = ["4.8", " 2.5 ", "1e3", "1.0d", "NA", "abc", "", "nan", None, "-.5", "+7."]
    assert one(spark, texts, to_number("v")) == [4.8, 2.5, 1000.0, None, None, None, None, None, None, -0.5, 7.0]


def test_wall_micros_ignores_zone(spark):
    moment = dt.datetime(2024, 3, 31, 2, 30, 0, 123456)
    got = one(spark, [moment], wall_micros("v"), "timestamp_ntz")
    assert got == [int((moment - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))]


def test_labels(spark):
    assert one(spark, ["so2"], label("v")) == ["SO2"]
    assert one(spark, [1234.567, None], display("v"), "double")[0] == "1234.57"


def test_normalize_missing(spark):
    df = spark.createDataFrame([("NA", 1.0), (" n/a ", float("nan")), ("x", None)], "s string, d double")
    assert rows(cleaning.normalize_missing(df)) == sorted([(None, 1.0), (None, None), ("x", None)], key=repr)


def test_impute_uses_all_rows_and_skips_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, None, None), (4.0, None, "b")], "x double, y double, k string")
    filled = cleaning.impute_mean(df, ["x", "y"])
    assert rows(filled, "x", "y") == [(1.0, None), (2.5, None), (4.0, None)]
    assert cleaning.drop_missing(filled, ["k"]).count() == 2


def test_resolve_time(spark):
    df = spark.createDataFrame([("March - M031991",), ("05-04-1992",), ("?",)], "sampling_date string")
    got = [r["date"] for r in cleaning.resolve_time(df).collect()]
    assert got == [dt.datetime(1991, 3, 1), dt.datetime(1992, 4, 5), None]
    with pytest.raises(ValueError):
        cleaning.resolve_time(df.withColumnRenamed("sampling_date", "z"))


def test_melt_round_trip(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "k string, x double, y double")
    assert rows(cleaning.melt(df, ["k"], ["x", "y"])) == [("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 3.0)]
    assert cleaning.melt_matrix(df, ["k"]).count() == 4


def test_csv_latin1(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("state,location,date,so2\nS\xe3o,NA,01-02-1990,4.5\nX,Y,bad,NA\n".encode("latin-1"))
    raw = read_observations(spark, str(path))
    assert all(t == "string" for _, t in raw.dtypes)
    wide = clean_observations(raw, ["so2"], required=["date"])
    got = wide.collect()
    assert len(got) == 1 and got[0]["state"] == "S\xe3o" and got[0]["location"] is None and got[0]["year"] == 1990
    assert rows(long_form(wide, ["so2"], ["state"])) == [("S\xe3o", "so2", 4.5)]
    with pytest.raises(FileNotFoundError):
        read_observations(spark, str(tmp_path / "missing.csv"))


def test_sinks(spark, obs, tmp_path):
    small = obs.select("state", "ts", "quantity")
    kept = export_filtered(small, Selection({"state": ["ASIA"]}, "ts", "1996-01-01", None), str(tmp_path / "x"))
    assert read_observations(spark, str(tmp_path / "x")).count() == kept.count() > 0
    write_table(small, str(tmp_path / "t"), "ts")
    back = read_table(spark, str(tmp_path / "t"))
    assert back.count() == small.count()
    assert "PartitionFilters: [isnotnull(year" in back.where("year = 1997")._jdf.queryExecution().toString()
    write_table(small, str(tmp_path / "u"))
    write_csv(small, str(tmp_path / "deep" / "er"))


def test_interval_and_pick(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 25), 1)], "t timestamp_ntz, z int")
    bar = cleaning.add_interval(cleaning.pick(df, ["t"]), "t").collect()[0]
    assert bar["end"] == dt.datetime(2020, 3, 6) and bar["start"] == dt.datetime(2020, 2, 25)


def test_filter_lists(spark, obs):
    from gaugework.operators import filters

    many = ["ASIA"] + [f"x{i}" for i in range(1500)]
    assert filters.filter_in(obs, "state", many).count() == filters.filter_in(obs, "state", ["ASIA"]).count()
    last = filters.last_period(obs, "ts", 1, "month").agg(F.min("ts"), F.max("ts")).collect()[0]
    assert (last[1] - last[0]).days <= 31
    with pytest.raises(ValueError):
        filters.last_period(obs, "ts", 1, "parsec")
