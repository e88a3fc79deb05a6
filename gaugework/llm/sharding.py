"""Shards by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents
from gaugework.session import cut_lineage

BITS = 60


def row_hash(key: Column) -> Column:
    """The first 60 bits of md5, as a number."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def document_key() -> Column:
    return F.concat_ws("|", F.col("doc_id").cast("string"), F.md5("text"))


def prefix_of(hashed: str | Column, depth: Column) -> Column:
    """The first ``depth`` bits of a 60-bit hash."""
    hashed = F.col(hashed) if isinstance(hashed, str) else hashed
    return F.call_function("shiftright", hashed, (F.lit(BITS) - depth).cast("int"))


def bit_text(prefix: Column, depth: Column) -> Column:
    return F.call_function("lpad", F.bin(prefix), depth.cast("int"), F.lit("0"))


def split_buckets(rows: DataFrame, byte_limit: int, margin: int = 4) -> DataFrame:
    """Shards (depth, prefix, shard_bytes, shard_rows) of rows (hashed, n_bytes).

    All buckets begin as one; a bucket above the limit that holds more than one row
    splits on the next bit, the others stay. The bytes are summed once per cell of a few
    bits more than the total asks for, and buckets of every depth are sums of cells; only
    cells that are still too large are read again, at more bits. A row above the limit
    stands alone; rows of one hash stay together.
    """
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / byte_limit)))) + margin)
    found: DataFrame | None = None
    while True:
        cells = rows.groupBy(prefix_of("hashed", F.lit(high)).alias("cell"))
        cells = cells.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
        deep = cells.select("b", "r", "cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        up = F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int"))
        nodes = deep.groupBy("depth", up.alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= byte_limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        nodes = cut_lineage(nodes.withColumn("fits", fits), "buckets")
        split = nodes.where("NOT fits").select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        )
        inside = nodes.where((F.col("depth") > low) | (F.col("depth") == 0)).where("fits")
        leaves = inside.where("depth = 0").unionByName(inside.where("depth > 0").join(split, ["depth", "prefix"], "left_semi"))
        leaves = leaves.drop("fits")
        found = leaves if found is None else found.unionByName(leaves)
        left = nodes.where((F.col("depth") == high) & ~F.col("fits")).select(F.col("prefix").alias("cell"))
        if high == BITS or left.isEmpty():
            return found
        rows = rows.withColumn("cell", prefix_of("hashed", F.lit(high))).join(left, "cell", "left_semi").drop("cell")
        low, high = high, min(BITS, high + 8)


def directory(shards: DataFrame) -> DataFrame:
    """The directory: one entry per value of the deepest prefix, naming its shard."""
    depth = shards.agg(F.max("depth").alias("d")).first()["d"] or 0
    first = F.call_function("shiftleft", F.col("prefix"), (F.lit(depth) - F.col("depth")).cast("int"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("depth")).cast("int"))
    entries = shards.withColumn("entry", F.explode(F.sequence(first, first + width - 1)))
    return entries.select("entry", F.lit(depth).alias("global_depth"), "depth", bit_text(F.col("prefix"), F.col("depth")).alias("shard"))


def extendible_shards(docs: DataFrame, byte_limit: int, key: Column | None = None, text: str = "text") -> DataFrame:
    """The shard of every row: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows.

    ``shard`` is the hash prefix in bits. The hash covers id and text, so that copies
    under several ids part; null texts have 0 bytes, null ids are hashed by text alone.
    Rows that are alike in both stay in one shard, even above the limit, as does a
    single row above it. Other columns of ``docs`` play no part.
    """
    hashed = row_hash(document_key() if key is None else key)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = cut_lineage(docs.select("doc_id", size.alias("n_bytes"), hashed.alias("hashed")), "sizes")
    shards = cut_lineage(split_buckets(rows.select("hashed", "n_bytes"), byte_limit), "shards")
    # Few distinct depths occur: a row looks its shard up once for each of them.
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())
    if not depths:
        depths = [0]
    looked = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    looked = looked.withColumn("prefix", prefix_of("hashed", F.col("depth")))
    placed = looked.join(shards, ["depth", "prefix"])
    shard = bit_text(F.col("prefix"), F.col("depth")).alias("shard")
    return placed.select("doc_id", "n_bytes", shard, "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the rows of ``docs`` (unique ids) below ``path``, one folder per shard."""
    sharded = docs.join(placed.select("doc_id", "shard"), "doc_id")
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


BYTE_LIMIT = 1 << 20


def op1_sharding(spark, sf_dir):
    return extendible_shards(documents(spark, sf_dir), BYTE_LIMIT)


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, md5(text))), 1, 15))::BIGINT AS h
  FROM documents
), tried AS (
  SELECT d.*, g.depth::INT AS depth, h >> ({BITS} - g.depth)::INT AS prefix
  FROM d, generate_series(0, {BITS}) AS g(depth)
), nodes AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM tried GROUP BY ALL
), fit AS (
  SELECT * FROM tried JOIN nodes USING (depth, prefix)
  WHERE shard_bytes <= {BYTE_LIMIT} OR shard_rows = 1 OR depth = {BITS}
)
SELECT doc_id, n_bytes, lpad(bin(prefix), depth, '0') AS shard, depth, shard_bytes, shard_rows
FROM fit QUALIFY row_number() OVER (PARTITION BY h, doc_id ORDER BY depth) = 1
"""
