"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import settled
from gaugework.llm.components import components
from gaugework.llm.vectors import as_matrix, fit_on, sample_of, usable_vectors
from gaugework.session import cut_lineage

SAMPLE = 50_000  # vectors the splits are fitted on
MAX_DEPTH = 12
TREES = 8
LEAF = 256  # vectors a leaf should hold
BLOCK = 1024  # vectors of a leaf that one task holds; larger leaves are compared block by block
SPILL = 0.5  # vectors that near to a split go both ways, in units of a link's reach
NARROW = math.sqrt(0.5)  # a node of less spread is not split: its typical pair is a link


def direction(seed: int, tree: int, node: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node]).normal(size=width) / math.sqrt(width)


def reach_of(threshold: float, width: int) -> float:
    """How far a projection takes apart, as a standard deviation, two unit vectors that are only just linked."""
    return math.sqrt(max(0.0, 2 - 2 * threshold) / width)


def cut_of(at: np.ndarray, margin: float) -> float:
    """The median, or where half as many vectors or fewer lie within the margin, nearest to it."""
    at = np.sort(at)
    tried = np.quantile(at, [0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7, 0.25, 0.75])
    near = np.searchsorted(at, tried + margin) - np.searchsorted(at, tried - margin)
    better = np.flatnonzero(near <= near[0] / 2)
    return tried[better[0]] if len(better) else tried[0]


def fit_tree(x: np.ndarray, depth: int, tree: int, seed: int, reach: float) -> np.ndarray:
    """(cut, margin) of each inner node, numbered as in a heap; NaN where it is not split.

    The margin is the same everywhere, as linked vectors are as far apart in a dense node as in any.
    """
    splits = np.full((1 << depth, 2), np.nan)
    groups = {1: np.arange(len(x))}
    for node in range(1, 1 << depth):
        rows = groups.pop(node, np.zeros(0, dtype=np.int64))
        if not len(rows):
            continue
        at = x[rows] @ direction(seed, tree, node, x.shape[1])
        low, high = np.quantile(at, [0.1, 0.9])
        if (high - low) / 2.563 <= NARROW * reach:  # as a standard deviation, without the strays
            continue
        splits[node] = cut_of(at, SPILL * reach), SPILL * reach
        groups[2 * node], groups[2 * node + 1] = rows[at <= splits[node, 0]], rows[at > splits[node, 0]]
    return splits


def leaves_of(x: np.ndarray, splits: np.ndarray, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs: a row near to a split is in the leaves of both sides."""
    inner = len(splits)
    open_, rows, leaves = [(1, np.arange(len(x)))], [], []
    while open_:
        node, here = open_.pop()
        if not len(here):
            continue
        if node >= inner or np.isnan(splits[node, 0]):
            rows.append(here)
            leaves.append(np.full(len(here), (tree << 32) | node, dtype=np.int64))
            continue
        at = x[here] @ direction(seed, tree, node, x.shape[1])
        cut, margin = splits[node]
        open_ += [(2 * node, here[at <= cut + margin]), (2 * node + 1, here[at > cut - margin])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable by the links (a, b), by union-find with halving."""
    parent = np.arange(n)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def seen_before(leaf: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether two rows share a leaf of a smaller number; leaf lists padded with -1."""
    out = np.zeros(len(one), dtype=bool)
    for i in range(one.shape[1]):
        early = (one[:, i] >= 0) & (one[:, i] < leaf)
        for j in range(two.shape[1]):
            out |= early & (one[:, i] == two[:, j])
    return out


def padded(lists: list[np.ndarray], leaf: int) -> np.ndarray:
    """Only leaves before ``leaf`` matter, in one row each."""
    lists = [np.asarray(v)[np.asarray(v) < leaf] for v in lists]
    out = np.full((len(lists), max([1, *map(len, lists)])), -1, dtype=np.int64)
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def linked_classes(classes: DataFrame, d: int, threshold: float, trees: int, seed: int) -> DataFrame:
    """(rep, linked, anchor) per class and leaf in which it has links.

    ``linked`` counts the vectors of other classes that are first met in this leaf, so that
    the sum over leaves counts each once; ``anchor`` is the smallest class of its group there.
    """
    spark = classes.sparkSession
    n = classes.count()
    reach = reach_of(threshold, d)
    depth = max(0, min(MAX_DEPTH, math.ceil(math.log2(max(1, n / LEAF)))))

    def fit(column):
        x = as_matrix(column, d)
        x /= np.sqrt(np.square(x).sum(axis=1, keepdims=True))
        out = io.BytesIO()
        np.savez(out, *[fit_tree(x, depth, t, seed, reach) for t in range(trees)])
        return out.getvalue()

    packed = fit_on(sample_of(classes.withColumnRenamed("rep", "vec_id"), n, SAMPLE), fit)
    forest = spark.sparkContext.broadcast(packed)  # at most trees x 4096 splits

    def place(batches):
        splits = np.load(io.BytesIO(forest.value))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(2), d)
            x /= np.sqrt(np.square(x).sum(axis=1, keepdims=True))
            found = [leaves_of(x, splits[f"arr_{t}"], t, seed) for t in range(trees)]
            row, leaf = (np.concatenate(v) for v in zip(*found, strict=True))
            order = np.lexsort((leaf, row))
            ends = np.searchsorted(row[order], np.arange(len(x) + 1))
            leaves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], ["rep", "copies", "embedding", "leaves"])

    shape = "rep long, copies long, embedding array<float>, leaves array<long>"
    placed = cut_lineage(classes.select("rep", "copies", "embedding").mapInArrow(place, shape), "leaves")
    # Vectors that shared an unsplit node before were compared there; where many of them meet again, not once more.
    unsplit = F.array_min(F.filter("leaves", lambda n: n % (1 << 32) < (1 << depth)))
    rows = placed.withColumn("met", unsplit).withColumn("leaf", F.explode("leaves"))
    rows = rows.withColumn("met", F.when(F.col("met") < F.col("leaf"), F.col("met")).otherwise(F.col("leaf")))
    sizes = rows.groupBy("leaf", "met").agg(F.count("*").alias("c"))
    of_leaf = Window.partitionBy("leaf")
    large = sizes.withColumn("all", F.sum("c").over(of_leaf)).where(F.col("all") > BLOCK)
    dealt = F.when(F.col("c") >= BLOCK, F.col("met")).otherwise(F.col("leaf")).alias("dealt")
    parted = large.select("leaf", dealt, "c").groupBy("leaf", "dealt").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("parts"))
    parted = parted.withColumn("first", F.coalesce(F.sum("parts").over(of_leaf.orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parted = parted.withColumn("blocks", F.sum("parts").over(of_leaf))
    large = large.select("leaf", "met", dealt).join(parted, ["leaf", "dealt"])
    rows = rows.join(settled(spark, large), ["leaf", "met"], "left")
    first, parts = F.coalesce("first", F.lit(0)), F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("own", (first + F.pmod(F.xxhash64("rep"), parts)).cast("int"))
    others = F.sequence(F.lit(0), (F.coalesce("blocks", F.lit(1)) - 1).cast("int"))
    anew = F.coalesce(F.col("dealt") == F.col("leaf"), F.lit(True))
    others = F.filter(others, lambda o: anew | (o < first) | (o >= first + parts))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select(
        "leaf", "rep", "copies", "embedding", "leaves", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    out_schema = pa.schema([("rep", pa.int64()), ("linked", pa.int64()), ("anchor", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = as_matrix(table.column("embedding"), d)
        x /= np.sqrt(np.square(x).sum(axis=1, keepdims=True))
        own, leaf = table.column("own").to_numpy(), table.column("leaf")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        near = np.triu(x @ x.T >= threshold, 1)
        if i != j:  # the two blocks by themselves are compared elsewhere
            near &= own[:, None] != own[None]
        a, b = np.nonzero(near)
        if not len(a):
            return out_schema.empty_table()
        lists = padded(table.column("leaves").to_pylist(), leaf)
        new = np.concatenate([~seen_before(leaf, lists[a[s : s + 65536]], lists[b[s : s + 65536]]) for s in range(0, len(a), 65536)])
        linked = np.zeros(len(rep), dtype=np.int64)
        np.add.at(linked, a[new], copies[b[new]])
        np.add.at(linked, b[new], copies[a[new]])
        roots = local_roots(len(rep), a, b)
        met = np.unique(np.concatenate([a, b]))
        return pa.Table.from_arrays([pa.array(rep[met]), pa.array(linked[met]), pa.array(rep[roots[met]])], schema=out_schema)

    return rows.groupBy("leaf", "i", "j").applyInArrow(compare, "rep long, linked long, anchor long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, seed: int = 29) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one class and are not compared with each other. Classes that share a
    leaf of a tree are compared by cosine in double precision; each pair counts once, in
    the first leaf that it shares. Links are never written out pair by pair. Unusable
    vectors (see ``usable_vectors``) have no links and are a component of their own; a
    null id has a null component and is kept. Splits are fitted on about SAMPLE vectors at most.
    """
    good, d = usable_vectors(vectors)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    alone = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    if not d:
        out = every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return out.select("*", alone)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut_lineage(classes, "vector-classes")
    found = cut_lineage(linked_classes(classes, d, threshold, trees, seed), "vector-links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("anchor").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    known = classes.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.where("copies > 1 OR linked IS NOT NULL").select(
        "embedding",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "rep").alias("c"),
    )
    out = every.join(cut_lineage(known, "vector-classes"), "embedding", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id"),
    )
    return out.select("*", alone)


def op6_forest(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
