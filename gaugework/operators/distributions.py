"""Histograms, box statistics, densities, hexagon counts, confidence bands and map cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.safe import nan_to_null, ratio, with_keys
from gaugework.operators.cleaning import melt
from gaugework.operators.joins import lookup, one_row
from gaugework.operators.quantiles import quantiles
from gaugework.session import settle, spread


def _long(df: DataFrame, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    clean = df.select(*keys, *[nan_to_null(F.col(m).cast("double")).alias(m) for m in measures])
    return melt(with_keys(clean, keys), keys, measures)


def _stats(df: DataFrame, measures: Sequence[str], keys: Sequence[str], aggs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Aggregates of every (keys…, measure) that has values, taken over the wide rows; only the result is long."""
    values = [nan_to_null(F.col(m).cast("double")) for m in measures]
    named = {"n": F.count} | aggs
    wide = with_keys(df, keys).groupBy(*keys).agg(*[f(v).alias(f"{name}_{i}") for i, v in enumerate(values) for name, f in named.items()])
    cells = [F.struct(F.lit(m).alias("measure"), *[F.col(f"{name}_{i}").alias(name) for name in named]) for i, m in enumerate(measures)]
    return wide.select(*keys, F.inline(F.array(*cells))).where("n > 0")


# --- histograms ------------------------------------------------------------------------


def histogram(df: DataFrame, measures: Sequence[str], bins: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts over [min, max] of each (keys…, measure), empty bins included.

    The last bin is closed; a constant measure gets a range of width one around it.
    """
    group = [*keys, "measure"]
    long = _long(df, measures, keys)
    flat = F.col("least") == F.col("most")
    ranges = _stats(df, measures, keys, {"least": F.min, "most": F.max}).select(
        *group,
        F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("low"),
        F.when(flat, F.col("most") + 0.5).otherwise(F.col("most")).alias("high"),
    )
    ranges = settle(ranges.withColumn("width", (F.col("high") - F.col("low")) / bins))
    guess = F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")).cast("int"), F.lit(bins - 1))
    # The quotient may round across an edge: the printed edges decide.
    below = F.col("value") < F.col("low") + guess * F.col("width")
    above = (F.col("value") >= F.col("low") + (guess + 1) * F.col("width")) & (guess < bins - 1)
    position = guess - below.cast("int") + above.cast("int")
    counted = (
        long.join(ranges, group)
        .withColumn("bin", position)
        .groupBy(*group, "bin")
        .agg(F.count("*").alias("n"))
    )
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edges = spine.select(
        *group,
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("left"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("right"),
    )
    filled = edges.join(counted, [*group, "bin"], "left")
    return filled.select(*group, "bin", "left", "right", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# --- box plots -------------------------------------------------------------------------


def _fences(df: DataFrame, measures: Sequence[str], keys: Sequence[str], reach: float) -> DataFrame:
    q = quantiles(df, measures, (0.25, 0.5, 0.75), keys)
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    spread = (q3 - q1) * reach
    return q.select(
        *keys, "measure", "n", q1.alias("q1"), median.alias("median"), q3.alias("q3"),
        (q1 - spread).alias("lower_fence"), (q3 + spread).alias("upper_fence"),
    )


def box_stats(df: DataFrame, measures: Sequence[str], keys: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme data within the fences) and the number of outliers."""
    group = [*keys, "measure"]
    fences = settle(_fences(df, measures, keys, reach))
    if not keys:
        # A few numbers per measure become literals: one pass over the columns as they are.
        ends = {r["measure"]: r for r in fences.collect()}
        values = {m: nan_to_null(F.col(m).cast("double")) for m in ends}
        aggs = []
        for m, r in ends.items():
            within = values[m].between(r["lower_fence"], r["upper_fence"])
            aggs += [f(F.when(within, values[m])).alias(f"{n}_{m}") for n, f in (("low", F.min), ("high", F.max))]
            aggs.append(F.count_if(~within).alias(f"out_{m}"))
        wide = one_row(df.agg(*aggs)) if aggs else None
        cases = {"whisker_low": "low", "whisker_high": "high", "outliers": "out"}
        picked = {c: F.coalesce(*[F.when(F.col("measure") == m, wide[f"{n}_{m}"]) for m in ends]) if ends else F.lit(None) for c, n in cases.items()}
        return fences.withColumns(picked).select("measure", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    whiskers = _long(df, measures, keys).join(fences, group).groupBy(*group).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return fences.join(whiskers, group).select(
        *group, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers"
    )


def box_outliers(df: DataFrame, measures: Sequence[str], keys: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Every value beyond the fences."""
    group = [*keys, "measure"]
    fences = settle(_fences(df, measures, keys, reach))
    beyond = ~F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    return _long(df, measures, keys).join(fences, group).where(beyond).select(*group, "value")


# --- densities -------------------------------------------------------------------------

# Cells of a quarter bandwidth and this many moments keep the error below 1e-10.
_CELLS_PER_BANDWIDTH = 4
_MOMENTS = 9
# A kernel further than this many bandwidths away contributes less than 1e-17.
_REACH = 9.0


def _power(name: str, k: int) -> str:
    return " * ".join([name] * k) or "1.0D"


def _hermite_sum() -> str:
    """SQL text for the sum over k of He_k(u) * moment_k / k!: a whole cell of Gaussian kernels."""
    total = "m0"
    polynomials = [[1], [0, 1]]
    for k in range(1, _MOMENTS):
        he = polynomials[k]
        terms = " + ".join(f"{c}D * {_power('u', i)}" for i, c in enumerate(he) if c)
        total += f" + ({terms}) * m{k} / {math.factorial(k)}D"
        # He_{k+1}(u) = u He_k(u) - k He_{k-1}(u)
        lower = [*polynomials[k - 1], 0, 0, 0]
        polynomials.append([a - k * b for a, b in zip([0, *he], lower, strict=False)])
    return total


def kde(
    df: DataFrame,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    points: int = 200,
    grid: str = "own",
    cut: float = 0.0,
    pad: float = 0.0,
    scale: str = "density",
    bins: int | None = None,
) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid.

    ``grid="own"`` spans each group's own data, extended by ``cut`` bandwidths;
    ``grid="shared"`` spans all groups of a measure, extended by ``pad`` times the range.
    ``scale="count"`` multiplies by rows × width of one of ``bins`` histogram bins.

    The rows are reduced once to moments per cell of a quarter bandwidth; the kernel
    sums are then expanded from the cells (the fast Gauss transform), so no row is
    ever paired with a grid point. Groups without spread have no density and are left out.
    """
    group = [*keys, "measure"]
    long = _long(df, measures, keys)
    stats = _stats(df, measures, keys, {"std": F.stddev_samp, "low": F.min, "high": F.max})
    stats = stats.withColumn("h", F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    stats = settle(stats)
    if grid == "shared":
        spans = stats.groupBy("measure").agg(F.min("low").alias("g_low"), F.max("high").alias("g_high"))
        extra = (F.col("g_high") - F.col("g_low")) * pad
        grids = stats.join(spans, "measure")
        grids = grids.withColumns({"first": F.col("g_low") - extra, "last": F.col("g_high") + extra})
    elif grid == "own":
        extra = F.col("h") * cut
        grids = stats.withColumns({"first": F.col("low") - extra, "last": F.col("high") + extra})
    else:
        raise ValueError(f"unknown grid {grid!r}")
    grids = grids.where(F.col("h") > 0).withColumn("step", (F.col("last") - F.col("first")) / (points - 1))
    factor = 1.0 / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    if scale == "count":
        factor = factor * F.col("n") * (F.col("high") - F.col("low")) / (bins or 50)
    grids = settle(grids.select(*group, "low", "h", "first", "step", factor.alias("factor")))

    size = F.col("h") / _CELLS_PER_BANDWIDTH
    in_cell = long.join(grids.select(*group, "low", "h"), group)
    in_cell = in_cell.withColumn("cell", F.floor((F.col("value") - F.col("low")) / size))
    offset = (F.col("value") - F.col("low") - (F.col("cell") + 0.5) * size) / F.col("h")
    moments = [F.expr(f"sum({_power('d', k)}) AS m{k}") for k in range(_MOMENTS)]
    cells = in_cell.withColumn("d", offset).groupBy(*group, "cell").agg(*moments)

    placed = cells.join(grids, group).withColumn("centre", F.col("low") + (F.col("cell") + 0.5) * size)
    lowest = F.ceil((F.col("centre") - _REACH * F.col("h") - F.col("first")) / F.col("step"))
    highest = F.floor((F.col("centre") + _REACH * F.col("h") - F.col("first")) / F.col("step"))
    placed = placed.withColumns(
        {
            "from_point": F.greatest(lowest, F.lit(0)).cast("int"),
            "to_point": F.least(highest, F.lit(points - 1)).cast("int"),
        }
    ).where(F.col("from_point") <= F.col("to_point"))
    near = placed.withColumn("point", F.explode(F.sequence("from_point", "to_point")))
    near = near.withColumn("u", (F.col("first") + F.col("point") * F.col("step") - F.col("centre")) / F.col("h"))
    sums = near.groupBy(*group, "point").agg(
        F.expr(f"sum(exp(-0.5D * u * u) * ({_hermite_sum()}))").alias("kernel_sum")
    )
    spine = grids.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    full = spine.join(sums, [*group, "point"], "left")
    x = F.col("first") + F.col("point") * F.col("step")
    # The expansion may undershoot zero by rounding where no data is near.
    height = F.greatest(F.coalesce("kernel_sum", F.lit(0.0)) * F.col("factor"), F.lit(0.0))
    return full.select(*group, "point", x.alias("x"), height.alias("density"))


# --- hexagons --------------------------------------------------------------------------


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """Counts on a hexagonal grid, as two offset rectangular lattices.

    Output: lattice (1 or 2), ix, iy, centre coordinates and n. Only occupied cells appear.
    """
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    points = df.select(nan_to_null(F.col(x).cast("double")).alias("x"), nan_to_null(F.col(y).cast("double")).alias("y"))
    points = points.dropna()
    box = points.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    for axis in "xy":
        # A constant axis is widened by a tenth of its value.
        low, high = F.col(f"{axis}0"), F.col(f"{axis}1")
        room = F.when(low == high, F.when(low == 0, 0.1).otherwise(F.abs(low) * 0.1)).otherwise(0.0)
        box = box.withColumn("room", room).withColumns({f"{axis}0": low - F.col("room"), f"{axis}1": high + F.col("room")})
    pad = (F.col("x1") - F.col("x0")) * 1e-9
    box = box.select(
        (F.col("x0") - pad).alias("x0"),
        ((F.col("x1") + pad - (F.col("x0") - pad)) / nx).alias("sx"),
        "y0",
        ((F.col("y1") - F.col("y0")) / ny).alias("sy"),
    )
    frame = one_row(box)
    placed = points.withColumns(
        {
            "gx": ratio(F.col("x") - frame["x0"], frame["sx"]),
            "gy": ratio(F.col("y") - frame["y0"], frame["sy"]),
        }
    )
    # One lattice has its centres on the grid corners, the other in the middle of the cells.
    # A point on the upper border is always nearer to a corner, so no cell lies outside.
    corner_x, corner_y = F.rint("gx"), F.rint("gy")
    middle_x, middle_y = F.floor("gx").cast("double"), F.floor("gy").cast("double")
    to_corner = F.pow(F.col("gx") - corner_x, F.lit(2)) + 3.0 * F.pow(F.col("gy") - corner_y, F.lit(2))
    to_middle = F.pow(F.col("gx") - middle_x - 0.5, F.lit(2)) + 3.0 * F.pow(F.col("gy") - middle_y - 0.5, F.lit(2))
    on_corner = to_corner < to_middle
    cells = placed.select(
        F.when(on_corner, 1).otherwise(2).alias("lattice"),
        F.when(on_corner, corner_x).otherwise(middle_x).cast("int").alias("ix"),
        F.when(on_corner, corner_y).otherwise(middle_y).cast("int").alias("iy"),
    )
    counts = cells.groupBy("lattice", "ix", "iy").agg(F.count("*").alias("n")).withColumn("box", frame)
    shift = F.when(F.col("lattice") == 2, 0.5).otherwise(0.0)
    return counts.select(
        "lattice", "ix", "iy",
        (F.col("box.x0") + (F.col("ix") + shift) * F.col("box.sx")).alias("x"),
        (F.col("box.y0") + (F.col("iy") + shift) * F.col("box.sy")).alias("y"),
        "n",
    )


# --- means with confidence bands ---------------------------------------------------------


def mean_ci_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    method: str = "normal",
    replicates: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Mean per key with a 95 % interval, by the normal approximation or a bootstrap.

    Groups of a single value have no interval.
    """
    rows = with_keys(df, keys).select(*keys, nan_to_null(F.col(value).cast("double")).alias("value"))
    rows = rows.where(F.col("value").isNotNull())
    if method == "normal":
        # Fixed value: the 97.5 % point of the standard normal distribution.
        half = 1.959963984540054 * F.stddev_samp("value") / F.sqrt(F.count("*"))
        return rows.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.avg("value").alias("mean"),
            (F.avg("value") - half).alias("low"),
            (F.avg("value") + half).alias("high"),
        )
    if method != "bootstrap":
        raise ValueError(f"unknown method {method!r}")
    # Equal values are merged first; everything else is computed from these cells.
    cells = rows.groupBy(*keys, "value").agg(F.count("*").alias("copies"))
    weighted = F.sum(F.col("value") * F.col("copies")) / F.sum("copies")
    means = cells.groupBy(*keys).agg(F.sum("copies").alias("n"), weighted.alias("mean"))
    ends = _bootstrap_ends(cells, list(keys), replicates, seed)
    several = F.col("n") > 1
    return means.join(ends, list(keys), "left").select(
        *keys, "n", "mean", F.when(several, F.col("low")).alias("low"), F.when(several, F.col("high")).alias("high")
    )


SALTS = 16  # parts that a key's distinct values are dealt to: one key may hold a third of all
BLOCK = 256  # distinct values that draw from one stream
LOOKED_UP = 256  # up to so many copies, weights come from a table


def _bootstrap_ends(cells: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """Poisson bootstrap: the 2.5 % and 97.5 % points of the resampled means per key.

    ``c`` copies of a value draw one Poisson(c) weight per replicate. Values come sorted by key and part
    of a key, and BLOCK of them at a time draw from a stream that a hash of key and first value seeds: the blocks
    depend on the values alone. A task adds up one key at a time and emits one row of weight sums for it;
    the second reduction adds the parts of a key and ranks its replicates.
    """
    salt, draw = F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"), F.xxhash64(F.lit(seed), *keys, "value")
    dealt = spread(cells.withColumns({"salt": salt, "draw": draw}), [*keys, "salt"])
    dealt = dealt.sortWithinPartitions(*keys, "salt", "value")
    fields = ", ".join(f"`{k}` {dict(cells.dtypes)[k]}" for k in keys)

    def weigh(values: np.ndarray, copies: np.ndarray, stream: int, tables: dict[int, tuple]) -> np.ndarray:
        rng = np.random.Generator(np.random.SFC64(stream))
        out = np.zeros((2, replicates))
        for c in np.unique(copies):
            x = values[copies == c]
            weights = _poisson(rng, int(c), (len(x), replicates), tables)
            out += weights.sum(axis=0), x @ weights
        return out

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[int, tuple] = {}
        for key, parts in _runs(batches, [*keys, "salt"]):
            blocks = _blocks((part[["value", "copies", "draw"]] for part in parts), BLOCK)
            sums = sum(weigh(b["value"].to_numpy(), b["copies"].to_numpy(), int(b["draw"].iloc[0]) % (1 << 64), tables) for b in blocks)
            yield pd.DataFrame([[*key, sums[0], sums[1]]], columns=[*keys, "salt", "w", "wx"])

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, parts in _runs(batches, keys):
            rows = pd.concat(parts)
            w, wx = np.sum(rows["w"].to_list(), axis=0), np.sum(rows["wx"].to_list(), axis=0)
            known = w > 0
            low, high = np.percentile(wx[known] / w[known], [2.5, 97.5]) if known.any() else (None, None)
            yield pd.DataFrame([[*key, low, high]], columns=[*keys, "low", "high"])

    partial = dealt.mapInPandas(add, f"{fields}, salt int, w array<double>, wx array<double>")
    # At most SALTS rows per key.
    gathered = partial.repartition(*keys).sortWithinPartitions(*keys, "salt")
    return gathered.mapInPandas(rank, f"{fields}, low double, high double")


def _poisson(rng: np.random.Generator, mean: int, shape: tuple[int, int], tables: dict[int, tuple]) -> np.ndarray:
    """Poisson weights, by 16 random bits where these decide and by a finer draw inside one of 65,536 where they do not.

    ``tables`` keeps, by mean, the distribution function and the weight of each 16 bits (65,535: not decided).
    """
    if mean > LOOKED_UP:
        return rng.poisson(mean, shape).astype(float)
    if mean not in tables:
        terms = [math.exp(-mean)]
        while len(terms) <= mean or terms[-1] > 1e-17:
            terms.append(terms[-1] * mean / len(terms))
        steps = np.cumsum(terms)
        edges = np.searchsorted(steps, np.arange(65537) / 65536, side="right")
        tables[mean] = steps, np.where(edges[:-1] == edges[1:], edges[:-1], 65535).astype(np.uint16)
    steps, table = tables[mean]
    size = shape[0] * shape[1]
    bits = rng.integers(0, 1 << 64, -(-size // 4), dtype=np.uint64).view(np.uint16)[:size].reshape(shape)
    small = table.take(bits)
    weights = small.astype(float)
    open_ = np.flatnonzero(small == 65535)
    finer = (bits.ravel()[open_] + rng.random(len(open_))) / 65536
    weights.ravel()[open_] = np.searchsorted(steps, finer, side="right")
    return weights


def _blocks(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of ``parts`` in blocks of ``size``, wherever the parts end; the last one is shorter."""
    held = None
    for part in parts:
        held = part if held is None else pd.concat([held, part])
        whole = len(held) - len(held) % size
        yield from (held.iloc[low : low + size] for low in range(0, whole, size))
        held = held.iloc[whole:]
    if held is not None and len(held):
        yield held


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[pd.DataFrame]]]:
    """Consecutive rows of equal keys, as (key, parts); a run may go over many batches."""
    parts = ((key, part) for batch in batches for key, part in batch.groupby(keys, sort=False))
    return ((key, (part for _, part in run)) for key, run in groupby(parts, key=lambda p: p[0]))


# --- maps ------------------------------------------------------------------------------


def grid_intensity(
    df: DataFrame,
    places: DataFrame,
    key: str,
    value: str,
    step: float = 1.0,
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Value-weighted intensity per map cell of ``step`` degrees.

    The rows are summed per place before the coordinates are attached.
    """
    clean = nan_to_null(F.col(value).cast("double"))
    per_place = with_keys(df, [key]).groupBy(key).agg(F.sum(clean).alias("total"), F.count(clean).alias("n"))
    located = lookup(per_place, places.select(key, lat, lon), key).dropna(subset=[lat, lon])
    cells = located.groupBy(
        F.floor(F.col(lat) / step).cast("long").alias("lat_cell"),
        F.floor(F.col(lon) / step).cast("long").alias("lon_cell"),
    )
    return cells.agg(F.sum("total").alias("intensity"), F.sum("n").alias("n"))
