"""What the operators of this folder share: names, folds, samples, model training, components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.session import cut_lineage, settle

# Rows of whole texts that a function works on at once. Spark itself bounds a batch by its bytes.
BATCH_ROWS = 512
# Bytes of all texts together that a classifier is fitted on.
SAMPLE_BYTES = 1 << 28


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterable[pa.RecordBatch]:
    """The same rows, few at a time, without a setting of the whole session. Batches without rows are left out."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column) % buckets, F.lit(0))


def hex_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5, the same in every SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks find it warm."""
    return sys.modules["pyspark"].__dict__.setdefault("_gaugework_caches", {}).setdefault(name, {})


def text_bytes(column: pa.Array) -> Iterable[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> tuple[DataFrame, float]:
    """Up to about ``per_class`` labelled training texts of either label, and the share of label 1.

    The bound is the documented one for fitting a classifier: rows are drawn by a hash of
    their id from the labelled rows that ``train`` (over ``doc_id``) selects. Whole texts of any length
    are fitted on; if those drawn hold more than SAMPLE_BYTES together, the same hash draws fewer of them, long and
    short alike. A document with several labels counts with the largest, an id with several texts with
    the first of them in order; null labels and ids take no part.
    """
    spark = docs.sparkSession
    rated = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
    rated = rated.where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")).where(train)
    counts = {r["y"]: r["n"] for r in rated.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    odds = F.when(F.col("y") == 1, per_class / max(1, counts.get(1, 0))).otherwise(per_class / max(1, counts.get(0, 0)))
    place = hex_uniform(F.concat(F.lit("sample|"), F.col("doc_id").cast("string"))) / F.least(F.lit(1.0), odds)
    picked = rated.select(F.col("doc_id").alias("_id"), "y", place.alias("place")).where("place < 1")
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    drawn = texts.join(settled(spark, picked), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("place").alias("place"))
    drawn = cut_lineage(drawn, "sample")
    size = drawn.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    return drawn.where(F.col("place") < SAMPLE_BYTES / max(size, SAMPLE_BYTES)).select("text", "y"), share


def settled(spark: SparkSession, small: DataFrame) -> DataFrame:
    """A table kept by its size, so that Catalyst broadcasts it only below its threshold; a scope lets go of it."""
    return settle(small)


def fit_in_task(sample: DataFrame, fit: Callable[[list[str], list[int]], bytes]) -> bytes:
    """Fit a model on a bounded sample in one task; its bytes come back.

    The rows are ordered by their text first, so that the model does not depend on
    the order in which they arrived.
    """

    def run(batches):
        rows = sorted((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit([t for t, _ in rows], [y for _, y in rows])], pa.binary())})

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(made[0]["model"]) if made else fit([], [])
