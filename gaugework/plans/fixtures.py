"""The benchmark star schema seen as a table of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.roles import Roles
from gaugework.sources import read_table

MEASURES = ("quantity", "price", "discount", "tax")
ROLES = Roles(time="ts", dims=("state", "location", "agency", "type"), measures=MEASURES)


# The columns of the given tables. Reading with a schema spares a job per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS.get(name))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: state, location, agency, type, ts and four measures.

    A tax of zero counts as not measured. Callers select what they need; unused
    columns never leave the scan. The dimensions are joined one after the other to
    the big table, so that each one's own size decides whether it is broadcast.
    """
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("r_name").alias("state"),
        F.col("n_name").alias("location"),
        F.col("s_name").alias("agency"),
        F.col("l_returnflag").alias("type"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
    )


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate per location, derived from its key; the location with key 7 has none."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey <> 7")
    return nation.select(
        F.col("n_name").alias("location"),
        (F.lit(8.0) + F.col("n_nationkey") * 1.25).alias("lat"),
        (F.lit(68.0) + F.pmod(F.col("n_nationkey") * 7, F.lit(28))).alias("lon"),
    )
