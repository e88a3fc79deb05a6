from __future__ import annotations

import pytest

from gaugework.plans.fixtures import observations
from gaugework.session import local_session

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, "6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def obs(spark):
    df = observations(spark, SMALL).persist()
    df.count()
    return df


def rows(df, *order):
    """Rows as tuples, sorted."""
    picked = df.select(*order) if order else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
