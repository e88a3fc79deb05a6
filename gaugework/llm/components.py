"""Connected components of a table of links, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.session import cut_lineage


def all_stars(edges: DataFrame) -> bool:
    """Whether every larger end ``u`` has one edge only and is no other edge's smaller end ``v``.

    Then each ``v`` is the smallest node of its component, and nothing is left to do.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    loose = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 AND n > 1")
    return loose.agg(F.count("*").alias("c")).first()["c"] == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Alternating rounds: every node hands the smallest node it knows to its larger
    neighbours, then to its smaller ones, until each node points at the smallest one of
    its component. A hub's neighbours are reduced to a minimum before they are shuffled
    and are joined back in a join that adaptive execution can split. Each round is a
    written table; nothing is gathered in one place. Links that are stars already need no round.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    edges = cut_lineage(edges.distinct(), "links")
    while not all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        # To the larger neighbours.
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut_lineage(large.distinct(), "large")
        # To the smaller ones and the node itself.
        lowest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        joined = large.join(lowest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merged(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels`` (node, component) after ``links`` between its nodes have joined components.

    Only the components that a link joins are worked on, not the links of earlier calls.
    """
    one = labels.select(F.col("node").alias(a), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias(b), F.col("component").alias("cb"))
    between = links.join(one, a).join(two, b).where("ca <> cb").select("ca", "cb")
    moved = components(between, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("into"))
    joined = labels.join(moved, "component", "left")
    return cut_lineage(joined.select("node", F.coalesce("into", "component").alias("component")), "labels")
