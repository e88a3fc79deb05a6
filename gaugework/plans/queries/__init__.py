"""The operators as queries over the given tables."""

from gaugework.plans.queries import cleaning, distributions, series, summaries  # noqa: F401
from gaugework.plans.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
