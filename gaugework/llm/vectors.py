"""What the two vector operators share: usable vectors, classes of equal ones, arrays in tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import hex_uniform


def usable_vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that can be compared, and their dimension.

    Left out are null ids, null and zero vectors, those that hold null or non-finite
    components, and those that are not of the commonest length (the smaller one of two).
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    good = good.where(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False)))
    sizes = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    commonest = sizes.agg(F.max(F.struct("n", -F.col("d"))).alias("m")).first()["m"]
    if commonest is None:
        return good, 0
    dimension = -commonest[1]
    return good.where(F.size("embedding") == dimension), dimension


def as_matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def sample_of(df: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` rows of ``n`` by a hash of their id, the bounded sample that an index is fitted on."""
    if n <= most:
        return df
    return df.where(hex_uniform(F.concat(F.lit("index|"), F.col("vec_id").cast("string"))) < most / n)


def fit_on(sample: DataFrame, fit) -> bytes:
    """Fit an index on (vec_id, embedding) rows in one task, in the order of their ids."""

    def run(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit(table.sort_by("vec_id").column("embedding"))], pa.binary())})

    rows = sample.select("vec_id", "embedding").repartition(1)
    return bytes(rows.mapInArrow(run, "model binary").collect()[0]["model"])


def parts_for(count: int, most: int) -> int:
    return max(1, math.ceil(count / most))
