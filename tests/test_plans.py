"""Queries against their SQL, and the composed reports."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from gaugework.operators.filters import Selection
from gaugework.plans.fixtures import MEASURES, ROLES, coordinates
from gaugework.plans.panels import choices, panels
from gaugework.plans.report import batch_report, write_report
from gaugework.roles import Roles
from tests.conftest import SMALL
from tools.check_queries import compare, connect

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    _, count, problem = compare(spark, duck, SMALL, name, QUERIES[name], SQL.get(name))
    assert problem is None
    assert count > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["location", "month_end", "measure", "value"]
    assert set(SQL) <= set(QUERIES)


def test_report(spark, obs, tmp_path):
    results = batch_report(obs, ROLES, places=coordinates(spark, SMALL))
    light = [n for n in results if n not in ("dendrogram", "cluster_trends", "decomposition", "ridgeline")]
    paths = write_report(results, str(tmp_path), light)
    assert len(paths) == len(light)
    for path in paths:
        assert spark.read.option("header", True).csv(path).count() > 0, path


def test_panels(spark, obs):
    picked = Selection({"state": ["ASIA", "EUROPE"]}, "ts", "1995-01-01", "2001-12-31")
    views = panels(obs, ROLES, picked, MEASURES[:2], places=coordinates(spark, SMALL))
    for name, build in views.items():
        if name not in ("cluster_trends",):
            assert build().limit(5).count() > 0, name
    empty = panels(obs, ROLES, Selection({"state": ["nowhere"]}))
    for name, build in empty.items():
        if name not in ("profile", "describe", "kpi", "cluster_trends", "heatmap"):
            assert build().count() == 0, name
    assert choices(obs, ROLES)["default_regions"]().count() == 3


def test_roles_are_checked(obs):
    with pytest.raises(ValueError):
        batch_report(obs, Roles("when", ("state",), ("price",)))
