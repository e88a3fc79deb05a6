"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Settings that keep results reproducible and let Spark re-plan around skew at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "gaugework", cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session, for tests and the bench only."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


LOCAL_FOLDERS: dict[str, str] = {}  # by application, for local sessions without a folder of their own


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in LOCAL_FOLDERS:
        LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="gaugework-")
    return LOCAL_FOLDERS[application]


class Held:
    """What operators keep in memory or write to the shared folder while a scope is open."""

    def __init__(self):
        self.frames: list[DataFrame] = []
        self.paths: list[str] = []


_SCOPES: list[Held] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[Held]:
    """Lets go of everything that operators keep or write inside, once the block ends.

    Results are lazy: consume them (collect, write) inside the block. Scopes may be nested;
    each lets go of what was made while it was the innermost one. Without a scope what is kept stays until
    ``spark.catalog.clearCache()``, and scratch tables stay in the shared folder.
    """
    held = Held()
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.remove(held)
        for frame in held.frames:
            frame.unpersist()
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in held.paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; the innermost open scope deletes it at its end."""
    path = f"{shared_dir(spark)}/gaugework-{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    return path


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back.

    The result no longer depends on the executors that computed it, and unlike a
    checkpoint the plan is run only once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Zero-based position of every row in the given order, without sorting in one task.

    The rows are range-partitioned and numbered inside their partition; the sizes of
    the partitions before give the shift.
    """
    numbered = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per partition: the only sort in a single task.
    shift = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    shifts = sizes.select("_part", shift.alias("_shift"))
    placed = numbered.withColumn("_part", part).join(shifts, "_part")
    return placed.withColumn(name, inside + F.col("_shift")).drop("_id", "_part", "_shift")


def settle(df: DataFrame) -> DataFrame:
    """Compute a summary table once and keep it, so that its real size is known.

    A plain join against the result is then broadcast by Catalyst only when the
    measured size is below ``spark.sql.autoBroadcastJoinThreshold``; a larger one is
    joined by a shuffle, which adaptive execution splits where a key is hot. What is
    kept has one row per key; the innermost ``scope`` lets go of it, or ``spark.catalog.clearCache()``.
    """
    kept = df.persist()
    if _SCOPES:
        _SCOPES[-1].frames.append(kept)
    kept.count()
    return kept


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition small but compute-heavy groups over all cores.

    Adaptive execution sizes partitions by bytes and would put such groups in one task.
    """
    spark = df.sparkSession
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wide, *keys)
