"""Registry of queries and, where SQL can state the same result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The observation table of gaugework.plans.fixtures, in SQL.
OBS = """
obs AS (
  SELECT r_name AS state, n_name AS location, s_name AS agency, l_returnflag AS type, l_shipdate AS ts,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, nullif(l_tax, 0) AS tax
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

LONG = """
long AS (
  SELECT state, location, type, ts, 'quantity' AS measure, quantity AS value FROM obs WHERE quantity IS NOT NULL
  UNION ALL SELECT state, location, type, ts, 'price', price FROM obs WHERE price IS NOT NULL
  UNION ALL SELECT state, location, type, ts, 'discount', discount FROM obs WHERE discount IS NOT NULL
  UNION ALL SELECT state, location, type, ts, 'tax', tax FROM obs WHERE tax IS NOT NULL
)"""


def query(name: str, sql: str | None = None, obs: bool = False, long: bool = False):
    """Register a query; ``obs`` and ``long`` put the common tables in front of the SQL."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            parts = [OBS] if obs or long else []
            parts += [LONG] if long else []
            body = sql.strip()
            if parts:
                joined = ",".join(parts)
                head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
                rest = f", {body[len(head):]}" if body.upper().startswith(head) else f"\n{body}"
                body = f"{head}{joined}{rest}"
            SQL[name] = body
        return build

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round after a shift of about 1 % of the last digit, as the SQL does too.

    Means of two-decimal values often end in an exact 5; without the shift the
    order of summation would decide which way they round.
    """
    shift = float(f"1.3717e-{digits + 2}")
    return df.withColumns({c: F.round(F.col(c) + shift, digits) for c in columns})


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def day(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd")


def with_days(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: day(c) for c in columns})
