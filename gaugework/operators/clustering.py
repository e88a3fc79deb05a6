"""Grouping of entities by the shape of their monthly means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.safe import ratio
from gaugework.operators.aggregates import monthly_mean
from gaugework.operators.joins import one_row
from gaugework.session import cut_lineage, settle


def feature_matrix(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    measures: Sequence[str],
    fill: float = 0.0,
) -> DataFrame:
    """One row per (entity…, measure): ``months`` and ``features``, one entry per month.

    The months are those seen anywhere in the input; a missing month is ``fill``.
    An entity's list is as long as the calendar, whatever its number of rows.
    """
    monthly = settle(monthly_mean(df, entity, time, measures))
    months = one_row(monthly.agg(F.array_sort(F.collect_set("month_end")).alias("months")))["months"]
    pairs = F.map_from_entries(F.collect_list(F.struct("month_end", "value")))
    profiles = monthly.groupBy(*entity, "measure").agg(pairs.alias("seen")).withColumn("months", months)
    features = F.transform("months", lambda m: F.coalesce(F.try_element_at("seen", m), F.lit(float(fill))))
    return profiles.select(*entity, "measure", "months", features.alias("features"))


def standardize(matrix: DataFrame) -> DataFrame:
    """Adds ``scaled``: z-scores per month over all entities; a month without spread gives 0."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("features"))
    stats = matrix.agg(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("variance"),
        F.col("s.count").cast("double").alias("n"),
    )
    # Population deviation, from the sample variance of the summary.
    population = F.transform("variance", lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n")))
    stats = stats.select("mean", population.alias("std"))
    scored = matrix.withColumn("stats", one_row(stats))
    cells = F.arrays_zip(
        F.col("features").alias("x"), F.col("stats.mean").alias("mean"), F.col("stats.std").alias("std")
    )
    z = F.transform(cells, lambda c: F.coalesce(ratio(c["x"] - c["mean"], c["std"]), F.lit(0.0)))
    return scored.withColumn("scaled", z).drop("stats")


UNIT = 1e9  # coordinates are whole numbers of this part, so that their sums are exact in any order
COST = 1e6  # and so are costs
HELD = 100_000  # points whose sums fit in 64 bits, at coordinates below 90,000


def _squared(at: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points, and their squared distances to every centre (points × restarts × centres)."""
    fixed = np.stack(at.to_list()) if len(at) else np.zeros((0, centres.shape[2]), dtype=np.int64)
    flat, x = centres.reshape(-1, centres.shape[2]), fixed / UNIT
    out = np.zeros((len(x), len(flat)))
    # One dimension after the other, so that a point's distance does not depend on its neighbours in the batch.
    for d in range(flat.shape[1]):
        out += (x[:, d, None] - flat[None, :, d]) ** 2
    return fixed, out.reshape(len(x), *centres.shape[:2])


def _draws(key: Column, k: int, restarts: int, seed: int) -> Column:
    """A uniform number per restart and centre, by a hash of the key that other engines can repeat."""

    def uniform(i: Column) -> Column:
        which = [F.floor(i / k).cast("string"), (i % k).cast("string")]
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(f"kmeans{seed}"), *which, key)), 1, 13)
        return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)

    return F.transform(F.sequence(F.lit(0), F.lit(restarts * k - 1)), uniform)


def _seeds(points: DataFrame, k: int, wanted: int, restarts: int) -> np.ndarray:
    """``wanted`` first centres of all restarts, one pass per centre: far points are likelier, by a race of the points' draws (``k`` a restart)."""
    chosen = np.zeros((restarts, 0, 0))
    for j in range(wanted):
        so_far = chosen

        def race(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                drawn = -np.log(np.stack(batch["draws"].to_list())[:, j::k])
                if so_far.shape[1]:
                    _, squared = _squared(batch["at"], so_far)
                    near = squared.min(axis=2)
                    drawn = np.where(near > 0, drawn / np.where(near > 0, near, 1), np.inf)
                order = np.argsort(batch["key"].to_numpy(), kind="stable")
                first = order[np.argmin(drawn[order], axis=0)]
                kept = {"restart": np.arange(restarts), "race": drawn[first, np.arange(restarts)]}
                yield pd.DataFrame(kept | {c: batch[c].iloc[first].to_list() for c in ("key", "at")})

        run = points.mapInPandas(race, "restart int, race double, key string, at array<long>")
        won = run.groupBy("restart").agg(F.min_by("at", F.struct("race", "key")).alias("at")).orderBy("restart").collect()
        centres = np.array([r["at"] for r in won]) / UNIT
        chosen = np.concatenate([chosen.reshape(restarts, j, centres.shape[1]), centres[:, None, :]], axis=1)
    return chosen


def _lap(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of the points nearest to each centre, for all restarts in one pass, and each restart's cost."""
    runs, k, width = centres.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts, cost, held = np.zeros((runs, k, width), dtype=np.int64), np.zeros((runs, k), dtype=np.int64), np.zeros(runs, dtype=np.int64), 0

        def rows() -> pd.DataFrame:
            which = [(r, c) for r in range(runs) for c in range(k)]
            values = [np.concatenate([[counts[r, c], cost[r] if c == 0 else 0], sums[r, c]]) for r, c in which]
            return pd.DataFrame({"restart": [r for r, _ in which], "centre": [c for _, c in which], "sums": values})

        for batch in batches:
            fixed, squared = _squared(batch["at"], centres)
            label = squared.argmin(axis=2)
            cost += np.rint(squared.min(axis=2) * COST).astype(np.int64).sum(axis=0)
            for r in range(runs):
                np.add.at(sums[r], label[:, r], fixed)
                counts[r] += np.bincount(label[:, r], minlength=k)
            held += len(batch)
            if held > HELD:
                yield rows()
                sums[:], counts[:], cost[:], held = 0, 0, 0, 0
        yield rows()

    partial = points.select("at").mapInPandas(add, "restart int, centre int, sums array<long>")
    each = partial.select("restart", "centre", F.posexplode("sums").alias("place", "value"))
    # restarts × centres × (coordinates + 2) numbers come back, whatever the number of points.
    totals = each.groupBy("restart", "centre", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    table = np.zeros((runs, k, width + 2), dtype=object)
    for r in totals:
        table[r["restart"], r["centre"], r["place"]] = int(r["value"])
    counts = table[:, :, :1]
    means = np.where(counts > 0, table[:, :, 2:] / np.where(counts > 0, counts, 1) / UNIT, centres)
    return means.astype(float), table[:, 0, 1].astype(float)


def kmeans(
    matrix: DataFrame,
    entity: Sequence[str],
    k: int = 5,
    seed: int = 42,
    restarts: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> DataFrame:
    """Adds ``cluster`` to a feature matrix: k-means on the standardised features.

    All ``restarts`` advance together: a seeding or Lloyd step is one aggregate over the points, and
    what returns has the size of the centres. Draws are hashes of the keys and sums are exact, so the result
    does not depend on partitions. The restart with the least cost is kept (the first of equal ones), ``k`` is reduced to the
    number of rows, and clusters are numbered by their smallest member; equal rows may leave fewer than ``k``.
    Fewer than two rows cannot be clustered and give an empty result.
    """
    names = [*entity, "measure"]
    fixed = F.transform("scaled", lambda x: F.rint(x * UNIT).cast("long"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in names])
    keyed = standardize(matrix).withColumns({"_at": fixed, "_key": key, "_draws": _draws(key, k, restarts, seed)})
    made = cut_lineage(keyed.drop("scaled"), "kmeans")
    rows = made.count()
    if rows < 2:
        return made.where(F.lit(False)).withColumn("cluster", F.lit(0)).drop("_at", "_key", "_draws")
    points = made.select(F.col("_key").alias("key"), F.col("_at").alias("at"), F.col("_draws").alias("draws"))
    centres = _seeds(points, k, min(k, rows), restarts)
    moving = np.arange(restarts)
    for _ in range(max_iter):
        means, _cost = _lap(points, centres[moving])
        shift = np.sqrt(((means - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
        centres[moving] = means
        moving = moving[shift > tol]
        if not len(moving):
            break
    _, cost = _lap(points, centres)
    best = centres[[int(np.argmin(cost))]]

    @F.pandas_udf("int")
    def nearest(at: pd.Series) -> pd.Series:
        return pd.Series(_squared(at, best)[1][:, 0].argmin(axis=1))

    labelled = made.withColumn("label", nearest("_at"))
    smallest = labelled.groupBy("label").agg(F.min(F.struct(*names)).alias("first"))
    # At most k rows are numbered here.
    numbers = smallest.select("label", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))
    return labelled.join(numbers, "label").drop("label", "_at", "_key", "_draws")


def cluster_trends(clustered: DataFrame) -> DataFrame:
    """Mean of the features per cluster and month."""
    months = F.arrays_zip(F.col("months").alias("month_end"), F.col("features").alias("value"))
    cells = clustered.select("cluster", F.inline(months))
    return cells.groupBy("cluster", "month_end").agg(F.avg("value").alias("value"))


def cluster_assignments(clustered: DataFrame, entity: Sequence[str]) -> DataFrame:
    return clustered.select(*entity, "measure", "cluster")
