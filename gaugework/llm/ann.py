"""Approximate nearest neighbours: an adaptive scan of rotated column blocks in probed lists."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.vectors import as_matrix, fit_on, parts_for, sample_of, usable_vectors
from gaugework.session import cut_lineage

SAMPLE = 20_000  # vectors the lists are fitted on, and the number of probes is measured on
MAX_LISTS = 1024
CANDIDATES = 4096  # rows of a list that one task scans
QUERIES = 2048  # queries that one task scans them for
COLUMNS = 16  # columns of a block
FEW = 0.2  # share of candidates alive below which they are measured one by one
CONFIDENCE = 2.1  # of the test that abandons a candidate: misses about exp(-2.1 ** 2)
WANTED_RECALL = 0.97  # on the sample


def widen(x: np.ndarray, longest: float) -> np.ndarray:
    """One more column makes all vectors equally long: the nearest is then the one of largest product."""
    rest = np.sqrt(np.maximum(0, longest**2 - np.square(x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def flat(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def rotation(width: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]


def list_order(q: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Lists from the nearest centre on."""
    away = np.square(centers).sum(axis=1)[None] - 2 * q @ centers.T
    return np.argsort(away, axis=1, kind="stable")


def fit_lists(x: np.ndarray, longest: float, lists: int, k: int, seed: int = 3, rounds: int = 8) -> bytes:
    """Centres by Lloyd's rounds, and the probes that find WANTED_RECALL of the k nearest in the sample."""
    rng = np.random.default_rng(seed)
    wide = widen(x, longest)
    centers = wide[np.sort(rng.permutation(len(wide))[: max(1, min(lists, len(wide)))])]
    for _ in range(rounds):
        nearest = list_order(wide, centers)[:, 0]
        counts = np.bincount(nearest, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, wide)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    nearest = list_order(wide, centers)[:, 0]
    asked = np.sort(rng.permutation(len(x))[:300])
    products = x[asked] @ x.T
    products[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-products, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(list_order(flat(x[asked]), centers), axis=1)
    needed = np.take_along_axis(place, nearest[top], axis=1) + 1
    probes = len(centers) if not needed.size else int(np.quantile(needed, WANTED_RECALL, method="higher"))
    out = io.BytesIO()
    np.savez(out, centers=centers, probes=probes)
    return out.getvalue()


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def scan(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, longest: float, turn: np.ndarray, k: int):
    """The k best of the candidates for each query: (query row, candidate row, product).

    The first candidates are measured in full and give each query a distance to beat. The
    others are measured by column blocks of the rotated vectors: after each block a
    candidate is abandoned when its distance over all columns, estimated from those seen,
    is larger beyond doubt; what survives all blocks is measured exactly.
    """
    rq, rx = flat(q) @ turn, widen(x, longest) @ turn
    width = rq.shape[1]
    first = min(len(x), max(64, 2 * k))
    length = np.square(q).sum(axis=1) + longest**2
    start = q @ x[:first].T
    start[q_ids[:, None] == ids[None, :first]] = -np.inf
    bound = np.full(len(q), np.inf)
    if first > k:
        kth = -np.partition(-start, k - 1, axis=1)[:, k - 1]
        bound = np.where(np.isfinite(kth), length - 2 * kth, np.inf)
    rows = [np.repeat(np.arange(len(q)), first)]
    cols = [np.tile(np.arange(first), len(q))]
    values = [start.ravel()]
    if first < len(x):
        def test(partial, seen, limit):
            doubt = (1 + CONFIDENCE / math.sqrt(seen)) ** 2 if seen < width else 1 + 1e-9
            return partial * (width / seen) <= limit * doubt

        # As long as most candidates are alive a block is one matrix product; then only the rest is touched.
        partial, seen = np.zeros((len(q), len(x) - first)), 0
        alive = np.ones(partial.shape, dtype=bool)
        while seen < width and alive.mean() > FEW:
            a, b = rq[:, seen : seen + COLUMNS], rx[first:, seen : seen + COLUMNS]
            partial += np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None] - 2 * a @ b.T
            seen = min(width, seen + COLUMNS)
            alive &= test(partial, seen, bound[:, None])
        at, col = np.nonzero(alive)
        partial = partial[at, col]
        for low in range(seen, width, COLUMNS):
            high = min(width, low + COLUMNS)
            partial = partial + np.square(rq[at, low:high] - rx[first + col, low:high]).sum(axis=1)
            stay = test(partial, high, bound[at])
            at, col, partial = at[stay], col[stay], partial[stay]
        exact = np.einsum("ij,ij->i", q[at], x[first + col])
        exact[q_ids[at] == ids[first + col]] = -np.inf
        rows.append(at)
        cols.append(first + col)
        values.append(exact)
    row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    real = np.isfinite(value)
    row, col, value = row[real], col[real], value[real]
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    begin = np.searchsorted(row, np.arange(len(q)))
    few = np.arange(len(row)) - begin[row] < k
    return row[few], col[few], value[few]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest inner product with each query.

    Both frames hold (vec_id, embedding); a query's own id is no candidate. Ties go to the
    smaller id, of repeated rows of one id one is returned, and a query with fewer
    candidates than ``k`` gets them all. Unusable vectors (see ``usable_vectors``)
    take no part. Lists and probes are fitted on at most about SAMPLE vectors; every
    vector is in a list, large lists are scanned by several tasks, and a query probes on until
    its lists hold enough candidates.
    """
    spark = vectors.sparkSession
    vectors, d = usable_vectors(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return empty
    vectors = vectors.dropDuplicates(["vec_id"])
    queries = usable_vectors(queries)[0].where(F.size("embedding") == d).dropDuplicates(["vec_id"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    totals = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    n, longest = totals["n"], totals["m"] * (1 + 1e-9)
    lists = max(1, min(MAX_LISTS, round(math.sqrt(n) / 2)))
    packed = fit_on(sample_of(vectors, n, SAMPLE), lambda c: fit_lists(as_matrix(c, d), longest, lists, k))
    index = spark.sparkContext.broadcast(packed)

    def deal(batches):
        centers = np.load(io.BytesIO(index.value))["centers"]
        for batch in batches:
            if batch.num_rows:
                nearest = list_order(widen(as_matrix(batch.column(1), d), longest), centers)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), *batch.columns], ["list", "vec_id", "embedding"])

    dealt = cut_lineage(vectors.mapInArrow(deal, "list int, vec_id long, embedding array<float>"), "lists")
    # At most MAX_LISTS numbers come to the driver here and below.
    sizes = np.zeros(lists, dtype=np.int64)
    for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]

    def probe(batches):
        model = np.load(io.BytesIO(index.value))
        for batch in batches:
            if not batch.num_rows:
                continue
            order = list_order(flat(as_matrix(batch.column(1), d)), model["centers"])
            held = np.cumsum(sizes[order], axis=1)
            enough = np.maximum(int(model["probes"]), (held < k + 1).sum(axis=1) + 1)
            row, at = np.nonzero(np.arange(order.shape[1])[None] < enough[:, None])
            taken = batch.take(pa.array(row))
            columns = [pa.array(order[row, at], pa.int32()), taken.column(0), taken.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["list", "query_id", "q"])

    asked = cut_lineage(queries.mapInArrow(probe, "list int, query_id long, q array<float>"), "probes")
    wanted = np.zeros(lists, dtype=np.int64)
    for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect():
        wanted[r["list"]] = r["n"]
    x_parts = F.element_at(F.array(*[F.lit(parts_for(c, CANDIDATES)) for c in sizes.tolist()]), F.col("list") + 1)
    q_parts = F.element_at(F.array(*[F.lit(parts_for(c, QUERIES)) for c in wanted.tolist()]), F.col("list") + 1)
    candidates = dealt.withColumn("x_part", F.pmod(F.xxhash64("vec_id"), x_parts).cast("int"))
    candidates = candidates.withColumn("q_part", F.explode(F.sequence(F.lit(0), q_parts - 1)))
    asked = asked.withColumn("q_part", F.pmod(F.xxhash64("query_id"), q_parts).cast("int"))
    asked = asked.withColumn("x_part", F.explode(F.sequence(F.lit(0), x_parts - 1)))
    turn = rotation(d + 1, seed)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        q, x = as_matrix(left.column("q"), d), as_matrix(right.column("embedding"), d)
        out = []
        for low in range(0, len(q), 256):
            row, col, value = scan(q[low : low + 256], q_ids[low : low + 256], x, ids, longest, turn, k)
            out.append(pa.Table.from_arrays([pa.array(q_ids[low + row]), pa.array(ids[col]), pa.array(value)], schema=schema))
        return pa.concat_tables(out)

    keys = ["list", "x_part", "q_part"]
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)
