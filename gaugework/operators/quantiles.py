"""Exact quantiles without holding a group's values in one task.

1. A mergeable sketch gives a few cut values around every wanted quantile.
2. One aggregate counts, exactly, how many values lie below and up to each cut.
3. A rank that falls on a cut value is answered by it. Otherwise it lies between two
   cuts, and only the values in there are grouped by value and ranked.

The counts of step 2 decide where a rank lies, so the result is exact however good the
sketch was; the sketch only decides how little data step 3 has to touch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.safe import nan_to_null, window_by, with_keys
from gaugework.operators.cleaning import melt
from gaugework.session import settle


# Bins per interval between two cuts; the fewer values a bin holds, the less one task ranks.
BINS = 1024


def _cut_points(probs: Sequence[float], accuracy: int) -> list[float]:
    margin = 2.0 / accuracy
    return sorted({min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)})


def _number_of(tests: Iterable[str]) -> str:
    """SQL text that counts how many tests hold."""
    return "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + ")"


def quantiles(
    df: DataFrame,
    measures: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    approximate: bool = False,
    accuracy: int = 10_000,
    also: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per (keys…, measure) with ``n`` and an array ``q``.

    ``approximate=True`` stops after the sketch: one pass, values within ``n / accuracy`` ranks. Without keys,
    the aggregates ``also`` names are taken of every measure in the pass of the sketch, as further columns.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    group = [*keys, "measure"]
    clean = with_keys(df, keys).select(*keys, *[nan_to_null(F.col(m).cast("double")).alias(m) for m in measures])
    if also and keys:
        raise ValueError("further aggregates are for whole tables")
    long = melt(clean, keys, measures)
    if approximate and not also:
        sketch = F.percentile_approx("value", probs, accuracy)
        return long.groupBy(*group).agg(F.count("*").alias("n"), sketch.alias("q"))

    points = _cut_points(probs, accuracy)
    size = len(points)
    positions = [f"({p!r}D * (n - 1))" for p in probs]
    if keys:
        counted = _count_by_key(long, group, points, accuracy)
    else:
        counted, long = _count_whole(clean, measures, points, probs, accuracy, approximate, also or {})
        if approximate:
            return counted

    # Every quantile needs the values at two neighbouring ranks. Place 2i is the open
    # interval below cut i and place 2i + 1 the cut itself; a rank lies at the place after
    # all those that end at or before it.
    ranks = [f"CAST({side}({p}) AS BIGINT)" for p in positions for side in ("floor", "ceil")]
    place_of = _number_of(f"upto[{i}] <= r" for i in range(2 * size))
    wanted = counted.select(*group, "n", "cuts", "upto", *(also or {}), F.expr(f"array({', '.join(ranks)})").alias("ranks"))
    wanted = wanted.withColumn("places", F.expr(f"transform(ranks, r -> {place_of})"))
    wanted = wanted.withColumn("before", F.expr("transform(places, s -> if(s = 0, 0, upto[greatest(s, 1) - 1]))"))
    wanted = settle(wanted.drop("upto")) if keys else wanted.drop("upto")

    located = long.join(wanted.select(*group, "cuts", "places"), group)
    sides = [f"value {side} cuts[{i}]" for i in range(size) for side in (">=", ">")]
    located = located.withColumn("place", F.expr(_number_of(sides)))
    thin = located.where("place % 2 = 0 AND array_contains(places, place)")
    # An interval is ranked in bins of equal width: running sums inside a bin, shifted by
    # the sizes of the bins before. Outside the outermost cuts there is a single bin.
    half = "CAST(place / 2 AS INT)"
    low, high = f"try_element_at(cuts, nullif({half}, 0))", f"try_element_at(cuts, {half} + 1)"
    spread = f"floor((value - {low}) / ({high} - {low}) * {BINS})"
    thin = thin.withColumn("bin", F.expr(f"CAST(coalesce(least({spread}, {BINS - 1}), 0) AS INT)"))
    values = thin.groupBy(*group, "place", "bin", "value").agg(F.count("*").alias("copies"))
    bins = values.groupBy(*group, "place", "bin").agg(F.sum("copies").alias("size"))
    earlier = F.sum("size").over(window_by([*group, "place"], "bin")) - F.col("size")
    bins = bins.select(*group, "place", "bin", earlier.alias("earlier"))
    inside = F.sum("copies").over(window_by([*group, "place", "bin"], "value"))
    ranked = values.withColumn("inside", inside).join(bins, [*group, "place", "bin"])
    ranked = ranked.withColumn("through", F.col("earlier") + F.col("inside"))

    at_rank = ", ".join(
        f"max(CASE WHEN place = places[{t}] AND ranks[{t}] < before[{t}] + through"
        f" AND ranks[{t}] >= before[{t}] + through - copies THEN value END)"
        for t in range(len(ranks))
    )
    between = ranked.join(wanted.select(*group, "ranks", "places", "before"), group).groupBy(*group)
    between = between.agg(F.expr(f"array({at_rank})").alias("found"))
    picked = wanted.join(between, group, "left").withColumn(
        "v", F.expr("transform(places, (s, t) -> if(s % 2 = 1, cuts[(s - 1) div 2], found[t]))")
    )
    interpolated = ", ".join(
        f"v[{2 * i}] + (v[{2 * i + 1}] - v[{2 * i}]) * ({p} - floor({p}))" for i, p in enumerate(positions)
    )
    result = picked.select(*group, "n", F.expr(f"array({interpolated})").alias("q"), *(also or {}))
    if not also:
        return result
    # Measures without a value keep their row here.
    blank = [F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("q"), *[F.lit(None).cast("double").alias(a) for a in also]]
    named = df.sparkSession.createDataFrame([(m,) for m in measures], "measure string")
    return result.unionByName(named.join(counted, "measure", "left_anti").select("measure", *blank))


def _count_by_key(long: DataFrame, group: list[str], points: list[float], accuracy: int) -> DataFrame:
    """n, cuts and the exact number of values below and up to each cut, per group."""
    sketch = F.percentile_approx("value", points, accuracy)
    cuts = settle(long.groupBy(*group).agg(F.count("*").alias("n"), sketch.alias("cuts")))
    # Only counts are aggregated here (no arrays), so this stays a hash aggregate.
    # A repeated cut leaves nothing below itself that its first copy has not counted.
    tests = ["value < cuts[0]", "value <= cuts[0]"]
    for i in range(1, len(points)):
        tests += [f"value < cuts[{i}] OR value <= cuts[{i - 1}]", f"value <= cuts[{i}]"]
    upto = ", ".join(f"count_if({t})" for t in tests)
    return long.join(cuts, group).groupBy(*group).agg(F.expr(f"array({upto})").alias("upto")).join(cuts, group)


def _count_whole(
    wide: DataFrame,
    measures: Sequence[str],
    points: list[float],
    probs: list[float],
    accuracy: int,
    approximate: bool,
    also: dict[str, Callable[[Column], Column]],
) -> tuple[DataFrame, DataFrame]:
    """The same for whole columns, and the long table of the values that can matter.

    All columns share each pass, and ``also`` the first one. The cuts (a few numbers per column) become
    literals, so the rows are neither multiplied nor joined.
    """
    sketches = [F.percentile_approx(m, probs if approximate else points, accuracy).alias(f"cuts_{m}") for m in measures]
    more = [f(F.col(m)).alias(f"{name}_{m}") for m in measures for name, f in also.items()]
    first = wide.agg(*[F.count(m).alias(f"n_{m}") for m in measures], *sketches, *more).collect()[0]
    extra = {m: [first[f"{name}_{m}"] for name in also] for m in measures}
    added = "".join(f", `{name}` double" for name in also)
    if approximate:
        rows = [(m, first[f"n_{m}"], first[f"cuts_{m}"], *extra[m]) for m in measures]
        return wide.sparkSession.createDataFrame(rows, f"measure string, n long, q array<double>{added}"), wide
    seen = [m for m in measures if first[f"n_{m}"]]
    tests = []
    for m in seen:
        for low, cut in pairwise([None, *first[f"cuts_{m}"]]):
            tests += [f"count_if(`{m}` {'<=' if low == cut else '<'} {_literal(cut)})", f"count_if(`{m}` <= {_literal(cut)})"]
    counts = list(wide.selectExpr(*tests).collect()[0]) if tests else []
    rows, kept, width = [], {}, 2 * len(points)
    for k, m in enumerate(seen):
        n, cuts, upto = first[f"n_{m}"], first[f"cuts_{m}"], counts[k * width : (k + 1) * width]
        rows.append((m, n, cuts, upto, *extra[m]))
        ranks = {side(p * (n - 1)) for p in probs for side in (math.floor, math.ceil)}
        edges = [None, *cuts, None]
        inside = []
        for place in {sum(u <= r for u in upto) for r in ranks}:
            if place % 2 == 0:
                low, high = edges[place // 2], edges[place // 2 + 1]
                above = [] if low is None else [f"`{m}` > {_literal(low)}"]
                below = [] if high is None else [f"`{m}` < {_literal(high)}"]
                inside.append(f"({' AND '.join(above + below)})")
        if inside:
            kept[m] = F.expr(f"CASE WHEN {' OR '.join(inside)} THEN `{m}` END").alias(m)
    counted = wide.sparkSession.createDataFrame(rows, f"measure string, n long, cuts array<double>, upto array<long>{added}")
    if not kept:
        return counted, melt(wide.where(F.lit(False)), [], measures)
    return counted, melt(wide.select(*kept.values()), [], list(kept))


def _literal(x: float) -> str:
    return f"double('{x!r}')"
