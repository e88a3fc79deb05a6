"""Ward hierarchical clustering in blocks of space whose bounding boxes bound what other blocks hold.

Ward distances are reducible: merging two clusters that are each other's nearest
neighbour never changes what greedy merging would have done. So a task may merge, inside
its block, every such pair that is nearer than anything in another block can be; boxes
and the smallest sizes in them give that bound, and it stays right while the other
blocks merge too. Only clusters at a block's border ask other blocks, and only those
whose boxes reach within the distance of their best candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.session import cut_lineage, number_rows, spread

SAMPLE = 1 << 14  # clusters from which a layout is cut; it decides where clusters lie, not what comes out
LEAVES = 1 << 12  # blocks of a layout at most: their boxes travel to every task
CLOSE = 1 + 1e-12  # bounds and heights are rounded differently
STATE = {"id": "long", "size": "long", "centre": "array<double>", "level": "double", "leaf": "int"}
FOUND = {"other": "long", "other_size": "long", "other_centre": "array<double>", "other_level": "double", "height": "double"}
LOCAL = STATE | FOUND | {"ask": "array<int>", "gone": "long", "turn": "int"}
NONE = (None, None, None, None, None)


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def _heights(size_a, x, size_b, y) -> np.ndarray:
    """Merge heights of every a with every b."""
    squared = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        squared += (x[:, d, None] - y[None, :, d]) ** 2
    a, b = np.asarray(size_a, float)[:, None], np.asarray(size_b, float)[None, :]
    return np.sqrt(2 * a * b / (a + b) * squared)


def _first(height: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per row the column of the smallest height; among equal ones the smaller id of the pair decides, then the larger."""
    low, high = np.minimum(i[:, None], j[None, :]), np.maximum(i[:, None], j[None, :])
    lowest = height == height.min(axis=1, keepdims=True)
    far = np.iinfo(np.int64).max
    low = np.where(lowest, low, far)
    return np.where(low == low.min(axis=1, keepdims=True), high, far).argmin(axis=1)


class Boxes:
    """The bounding box and the smallest size of every block."""

    def __init__(self, leaf: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.leaf, self.least, self.low, self.high = leaf, least, low, high

    def bounds(self, size: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Per cluster and block a height that no merge of the two can be below."""
        squared = np.zeros((len(x), len(self.leaf)))
        for d in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[None, :, d] - x[:, d, None], x[:, d, None] - self.high[None, :, d]), 0)
            squared += gap**2
        a, b = size.astype(float)[:, None], self.least[None, :]
        return np.sqrt(2 * a * b / (a + b) * squared)


def _cut(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A tree of splits at the median of the widest axis, as (axis, value) in heap order."""
    depth = max(0, (leaves - 1).bit_length())
    splits: list[tuple[int, float]] = []
    parts = [points]
    for _ in range(depth):
        halves = []
        for part in parts:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            splits.append((axis, value))
            halves += [part[part[:, axis] < value], part[part[:, axis] >= value]] if len(part) else [part, part]
        parts = halves
    return splits


def _placed(clusters: DataFrame, count: int, block: int) -> DataFrame:
    """``clusters`` with the block of each. A layout is cut from a bounded sample."""
    leaves = min(LEAVES, -(-count // block))
    if leaves == 1:
        return clusters.withColumn("leaf", F.lit(0))
    sample = clusters.orderBy(F.xxhash64("id")).limit(SAMPLE).select("centre").collect()
    splits = _cut(np.array([r["centre"] for r in sample]), leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["centre"].to_list()) if len(batch) else np.zeros((0, 1))
            node = np.zeros(len(batch), dtype=np.int64)
            axes, values = (np.array(v) for v in zip(*splits, strict=True))
            for _ in range((len(splits) + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[np.arange(len(x)), axes[node]] >= values[node])
            yield batch.assign(leaf=(node - len(splits)).astype("int32"))

    return clusters.select(*[c for c in STATE if c != "leaf"]).mapInPandas(place, _schema(STATE))


def _boxes(state: DataFrame, dimensions: int) -> tuple[Boxes, int]:
    """The boxes of all blocks (at most LEAVES rows come back) and the number of clusters."""
    axes = [F.col("centre")[d] for d in range(dimensions)]
    ends = [f(a).alias(f"{n}{d}") for n, f in (("low", F.min), ("high", F.max)) for d, a in enumerate(axes)]
    rows = state.groupBy("leaf").agg(F.count("*").alias("n"), F.min("size").alias("least"), *ends).collect()
    low, high = (np.array([[r[f"{n}{d}"] for d in range(dimensions)] for r in rows]).reshape(len(rows), dimensions) for n in ("low", "high"))
    leaf, least = np.array([r["leaf"] for r in rows]), np.array([float(r["least"]) for r in rows])
    return Boxes(leaf, least, low, high), sum(r["n"] for r in rows)


def _merge_inside(part: pd.DataFrame, boxes: Boxes) -> pd.DataFrame:
    """Merge what no other block can disturb; the rest comes back with its best candidate and the blocks to ask."""
    ids, size = part["id"].to_numpy(), part["size"].to_numpy()
    x, level = np.stack(part["centre"].to_list()), part["level"].to_numpy()
    leaf = int(part["leaf"].iloc[0])
    others = boxes.leaf != leaf
    outside = Boxes(boxes.leaf[others], boxes.least[others], boxes.low[others], boxes.high[others])
    height = _heights(size, x, size, x)
    np.fill_diagonal(height, np.inf)
    bound = outside.bounds(size, x)
    live, out, turn = np.arange(len(ids)), [], 0
    while True:
        near = live[_first(height[np.ix_(live, live)], ids[live], ids[live])]
        best = height[live, near]
        reach = bound[live].min(axis=1, initial=np.inf)
        to = np.full(len(ids), -1)
        to[live] = near
        mutual = (to[near] == live) & (ids[live] < ids[near]) & np.isfinite(best)
        safe = np.full(len(ids), -np.inf)
        safe[live] = reach
        mutual &= (best * CLOSE < reach) & (best * CLOSE < safe[near])
        if not mutual.any():
            break
        keep, gone = live[mutual], near[mutual]
        a, b = size[keep].astype(float)[:, None], size[gone].astype(float)[:, None]
        made = np.maximum(best[mutual], np.maximum(level[keep], level[gone]))
        x[keep] = (x[keep] * a + x[gone] * b) / (a + b)
        size[keep] += size[gone]
        level[keep] = made
        for k, g, h in zip(keep, gone, made, strict=True):
            out.append((ids[k], size[k], x[k].tolist(), h, leaf, *NONE, None, ids[g], turn))
        live = np.setdiff1d(live, gone)
        fresh = _heights(size[keep], x[keep], size[live], x[live])
        height[np.ix_(keep, live)], height[np.ix_(live, keep)] = fresh, fresh.T
        height[keep, keep] = np.inf
        bound[keep] = outside.bounds(size[keep], x[keep])
        turn += 1
    for at, i in enumerate(live):
        n, h = near[at], best[at]
        found = (ids[n], size[n], x[n].tolist(), level[n], h) if np.isfinite(h) else NONE
        ask = outside.leaf[bound[i] <= h * CLOSE].tolist()
        out.append((ids[i], size[i], x[i].tolist(), level[i], leaf, *found, ask, None, None))
    return pd.DataFrame(out, columns=list(LOCAL))


def _ask(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """The nearest cluster of a block for every asking one."""
    if asking.empty or block.empty:
        return pd.DataFrame(columns=["id", *FOUND], dtype=object)
    x, y = np.stack(asking["centre"].to_list()), np.stack(block["centre"].to_list())
    ids, own = asking["id"].to_numpy(), block["id"].to_numpy()
    picks, heights = [], []
    for at in range(0, len(x), 1024):
        here = slice(at, at + 1024)
        height = _heights(asking["size"].to_numpy()[here], x[here], block["size"].to_numpy(), y)
        pick = _first(height, ids[here], own)
        picks.append(pick)
        heights.append(height[np.arange(len(pick)), pick])
    pick = np.concatenate(picks)
    found = block.iloc[pick].reset_index(drop=True)
    return pd.DataFrame(
        {"id": ids, "other": own[pick], "other_size": found["size"], "other_centre": found["centre"], "other_level": found["level"], "height": np.concatenate(heights)}
    )


def _inside(state: DataFrame, boxes: Boxes) -> DataFrame:
    """Every block's own merges (rows with ``gone``) and what is left of it."""
    return spread(state, ["leaf"]).groupBy("leaf").applyInPandas(lambda part: _merge_inside(part, boxes), _schema(LOCAL))


def _across(left: DataFrame) -> DataFrame:
    """The clusters that are left, with their nearest one in any block."""
    asking = left.select("id", "size", "centre", F.explode("ask").alias("leaf"))
    block = left.select(*STATE)
    answers = asking.groupBy("leaf").cogroup(block.groupBy("leaf")).applyInPandas(_ask, "id long, " + _schema(FOUND))
    own = left.where(F.col("other").isNotNull()).select("id", *FOUND)
    order = F.struct("height", F.least("id", "other"), F.greatest("id", "other"))
    best = own.unionByName(answers).groupBy("id").agg(F.min_by(F.struct(*FOUND), order).alias("best"))
    return block.join(best, "id", "left").select(*STATE, "best.*")


def _merge_mutual(nearest: DataFrame) -> DataFrame:
    """The clusters after merging mutual nearest ones, which become one row (with ``gone``)."""
    back = nearest.select(F.col("id").alias("other"), F.col("other").alias("id"), F.lit(True).alias("mutual"))
    paired = nearest.join(back, ["id", "other"], "left")
    paired = paired.where(F.col("mutual").isNull() | (F.col("id") < F.col("other")))
    both = F.col("size") + F.col("other_size")
    mixed = F.zip_with("centre", "other_centre", lambda p, q: (p * F.col("size") + q * F.col("other_size")) / both)

    def either(merged, alone):
        return F.when(F.col("mutual"), merged).otherwise(alone)

    # The new columns get names of their own: inside a lambda, a name that is also an
    # alias of the same select would mean the alias.
    merged = paired.select(
        "id",
        either(both, F.col("size")).alias("new_size"),
        either(mixed, F.col("centre")).alias("new_centre"),
        either(F.greatest("height", "level", "other_level"), F.col("level")).alias("new_level"),
        "leaf",
        either(F.col("other"), F.lit(None)).cast("long").alias("gone"),
    )
    return merged.toDF(*STATE, "gone")


def ward_linkage(profile: DataFrame, key: str, measures: Sequence[str], block: int = 500) -> DataFrame:
    """Merge table of the rows of ``profile``: step, left, right, height, size.

    Leaves are numbered by their sorted key; step ``s`` creates cluster ``n + s``.
    Fewer than two rows give no merges. Every round is written to the shared folder,
    so a lost executor costs at most the current round. Each round halves, at least about, what fits in blocks: a
    block holds about ``block`` clusters (more above ``LEAVES`` blocks) and is compared in full; other blocks only where boxes come near.
    """
    leaves = number_rows(profile.where(F.col(key).isNotNull()), [key], "id")
    centre = F.array(*[F.col(m).cast("double") for m in measures])
    start = leaves.select("id", F.lit(1).cast("long").alias("size"), centre.alias("centre"), F.lit(0.0).alias("level"))
    start = cut_lineage(start, "ward")
    total = laid = count = start.count()
    state = _placed(start, count, block)
    merges = profile.sparkSession.createDataFrame([], "keep long, gone long, height double, size long, turn int, step_in int")
    turn = 0

    def add(made: DataFrame, at: int):
        step = F.col("turn") if "turn" in made.columns else F.lit(0)
        rows = made.where(F.col("gone").isNotNull())
        named = [F.col("id").alias("keep"), "gone", F.col("level").alias("height"), "size", F.lit(at).alias("turn"), step.alias("step_in")]
        return merges.unionByName(rows.select(*named))

    while count > 1:
        state = cut_lineage(state, "ward")
        boxes, _ = _boxes(state, len(measures))
        inside = cut_lineage(_inside(state, boxes), "ward")
        merges = add(inside, turn)
        left = inside.where(F.col("gone").isNull())
        count = left.count()
        turn += 1
        if count == 1:
            break
        state = left.select(*STATE)
        if len(boxes.leaf) > 1:
            across = cut_lineage(_merge_mutual(_across(left)), "ward")
            merges = add(across, turn)
            state = across.select(*STATE)
            count = across.count()
            turn += 1
        if count * 2 <= laid or len(boxes.leaf) == 1:
            laid, state = count, _placed(state.drop("leaf"), count, block)
    steps = number_rows(merges, ["height", "turn", "step_in", "keep"], "step")
    # A cluster is known by its smallest leaf; its number is that of the merge that made it.
    chain = Window.partitionBy("keep").orderBy("step")
    made = F.col("step") + F.lit(total)
    steps = steps.withColumns({"made": made, "left": F.coalesce(F.lag(made).over(chain), F.col("keep"))})
    last = steps.groupBy(F.col("keep").alias("gone")).agg(F.max("made").alias("made_gone"))
    full = steps.join(last, "gone", "left").withColumn("right", F.coalesce("made_gone", "gone"))
    return full.select("step", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "height", "size")
