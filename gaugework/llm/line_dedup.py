"""Line dedup that can be undone: exact reference counts, and sharded cuckoo filters over them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import documents, fresh
from gaugework.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4  # fingerprints of a bucket
KICKS = 200  # moves before a filter counts as full
FIRST = 256  # buckets of a shard's first filter; every further one doubles
SALTS = 8  # parts of a shard when lines are looked up: a line may be in a third of all documents
# The multiplier of a common 32-bit mixing step.
MIX = 0x5BD1E995


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each in one of two places; entries can be deleted.

    A key is two numbers: ``place`` chooses the bucket, ``mark`` is the fingerprint (1 to 65,535).
    The other bucket is the first one xor a hash of the mark, so it is found from either side.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table

    def other(self, bucket, mark):
        return (bucket ^ (mark * MIX >> 7)) & self.mask

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.table[bucket]
        for slot in range(SLOTS):
            if row[slot] == 0:
                row[slot] = mark
                return True
        return False

    def add(self, place: int, mark: int) -> bool:
        """False, and nothing changed, where no room is found."""
        first = place & self.mask
        second = self.other(first, mark)
        if self._put(first, mark) or self._put(second, mark):
            return True
        trail, bucket, held = [], second, mark
        for kick in range(KICKS):
            slot = (held + kick) % SLOTS
            trail.append((bucket, slot))
            held, self.table[bucket, slot] = int(self.table[bucket, slot]), held
            bucket = self.other(bucket, held)
            if self._put(bucket, held):
                return True
        for bucket, slot in reversed(trail):
            held, self.table[bucket, slot] = int(self.table[bucket, slot]), held
        return False

    def remove(self, place: int, mark: int) -> bool:
        first = place & self.mask
        for bucket in (first, self.other(first, mark)):
            for slot in range(SLOTS):
                if self.table[bucket, slot] == mark:
                    self.table[bucket, slot] = 0
                    return True
        return False

    def holds(self, places: np.ndarray, marks: np.ndarray) -> np.ndarray:
        first = places & self.mask
        second = self.other(first, marks)
        wanted = marks[:, None]
        return (self.table[first] == wanted).any(axis=1) | (self.table[second] == wanted).any(axis=1)


class Shard:
    """The filters of one shard. A full one is followed by another of twice its size."""

    def __init__(self, data: bytes | None = None):
        self.filters: list[CuckooFilter] = []
        at = 0
        while data and at < len(data):
            (buckets,) = struct.unpack_from("<I", data, at)
            size = buckets * SLOTS * 2
            table = np.frombuffer(data, dtype="<u2", count=buckets * SLOTS, offset=at + 4).reshape(buckets, SLOTS).copy()
            self.filters.append(CuckooFilter(buckets, table))
            at += 4 + size

    def add(self, place: int, mark: int) -> None:
        if not any(f.add(place, mark) for f in reversed(self.filters)):
            self.filters.append(CuckooFilter(FIRST << len(self.filters)))
            self.filters[-1].add(place, mark)

    def remove(self, place: int, mark: int) -> None:
        """Of a key that was added. Equal marks in equal buckets are alike, so any one of them may go."""
        if not any(f.remove(place, mark) for f in self.filters):
            raise ValueError("a line to remove is not in its filter")

    def holds(self, places: np.ndarray, marks: np.ndarray) -> np.ndarray:
        found = np.zeros(len(places), dtype=bool)
        for f in self.filters:
            found |= f.holds(places, marks)
        return found

    def data(self) -> bytes:
        parts = [struct.pack("<I", len(f.table)) + f.table.astype("<u2").tobytes() for f in self.filters]
        return b"".join(parts)


def key_numbers(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place, mark) from the bytes of 16-byte keys."""
    flat = np.frombuffer(b"".join(keys.to_pylist()), dtype="<u4").reshape(-1, 4).astype(np.int64)
    return flat[:, 1], flat[:, 2] % 65_535 + 1


def in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes | None, pa.RecordBatch]]:
    """Batches cut at changes of (_shard, _salt), each with its shard's filter, which comes first there."""
    now, data = None, None
    for batch in batches:
        names = batch.schema.names
        keys = np.stack([batch.column(names.index(c)).to_numpy() for c in ("_shard", "_salt")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            key = tuple(keys[:, low].tolist())
            if key != now:
                now, data = key, None
            heads = part.column(names.index("_data"))
            if heads[0].is_valid:
                data, part = heads[0].as_py(), part.slice(1)
            yield key, data, part


def line_keys(text: Column) -> Column:
    """The key of every line: blanks stripped at both ends, A to Z in lower case. A null text is one empty line."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(BLANKS)))


def digest16(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


@dataclass(frozen=True)
class LineIndex:
    """How many documents hold each line, and filters of the lines that enough of them hold.

    ``counts`` has (shard, key, n_docs) for every line of at least ``min_chars`` code points, exactly;
    ``filters`` has (shard, data), the cuckoo filters of the keys with ``n_docs >= min_docs``. Both are tables
    in the shared folder: an insertion or deletion writes new ones and leaves these as they are.

    Rows count as documents, repeated ones and null ids too; a null text is an empty line. Deleting
    what was never inserted is an error where a count would fall below zero.
    """

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    @staticmethod
    def empty(spark: SparkSession, min_docs: int = 10, min_chars: int = 1, shards: int | None = None) -> LineIndex:
        counts = spark.createDataFrame([], "shard int, key binary, n_docs long")
        filters = spark.createDataFrame([], "shard int, data binary")
        return LineIndex(counts, filters, min_docs, min_chars, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.crc32(key), F.lit(self.shards)).cast("int")

    def changes(self, docs: DataFrame) -> DataFrame:
        """(key, n) of the documents' lines; a document counts once for each."""
        kept = F.filter(line_keys(F.col("text")), lambda k: F.length(k) >= self.min_chars)
        keys = docs.select(F.explode(F.array_distinct(F.transform(kept, digest16))).alias("key"))
        return keys.groupBy("key").agg(F.count("*").alias("n"))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(self.changes(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(self.changes(docs).withColumn("n", -F.col("n")))

    def _changed(self, changes: DataFrame) -> LineIndex:
        before = self.counts.select("key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("n"))
        both = before.unionByName(changes.select("key", F.lit(0).cast("long").alias("was"), F.col("n")))
        sums = both.groupBy("key").agg(F.sum("was").alias("was"), F.sum("n").alias("n"))
        sums = sums.select(self.shard_of(F.col("key")).alias("shard"), "key", "was", (F.col("was") + F.col("n")).alias("n_docs"))
        sums = cut_lineage(sums, "line-counts")
        if not sums.where("n_docs < 0").isEmpty():
            raise ValueError("documents to delete hold lines that were never inserted")
        turned = sums.where((F.col("was") >= self.min_docs) != (F.col("n_docs") >= self.min_docs))
        moves = turned.select("shard", "key", (F.col("n_docs") >= self.min_docs).alias("enters"))
        counts = sums.where("n_docs > 0").select("shard", "key", "n_docs")
        return LineIndex(counts, cut_lineage(self._moved(moves), "line-filters"), self.min_docs, self.min_chars, self.shards)

    def _moved(self, moves: DataFrame) -> DataFrame:
        """The filters after deletions and insertions, each shard in one task."""
        zero = F.lit(0)
        heads = self.filters.select(F.col("shard").alias("_shard"), zero.alias("_salt"), F.lit(0).alias("_kind"), F.col("data").alias("_data"))
        # Deletions first: they make room.
        rows = moves.select(F.col("shard").alias("_shard"), zero.alias("_salt"), F.when(F.col("enters"), 2).otherwise(1).alias("_kind"), "key")
        both = heads.unionByName(rows, allowMissingColumns=True)
        ordered = both.repartition("_shard").sortWithinPartitions("_shard", "_kind", "key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, shard = None, Shard()

            def row():
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([shard.data()], pa.binary())], ["shard", "data"])

            for (number, _), data, part in in_shards(batches):
                if number != now:
                    if now is not None:
                        yield row()
                    now, shard = number, Shard(data)
                places, marks = key_numbers(part.column(4))
                for kind, place, mark in zip(part.column(2).to_pylist(), places.tolist(), marks.tolist(), strict=True):
                    (shard.add if kind == 2 else shard.remove)(place, mark)
            if now is not None:
                yield row()

        return ordered.select("_shard", "_salt", "_kind", "_data", "key").mapInArrow(run, "shard int, data binary")

    def candidates(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (with ``key`` and ``_salt``) that their shard's filter holds: all frequent ones, few others."""
        heads = self.filters.select(F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.col("data").alias("_data"))
        rows = lines.withColumn("_shard", self.shard_of(F.col("key"))).withColumn("_head", F.lit(1))
        both = heads.withColumn("_head", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        ordered = both.repartition("_shard", "_salt").sortWithinPartitions("_shard", "_salt", "_head")
        names = lines.columns
        ordered = ordered.select("_shard", "_data", *names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = Shard(), None
            for _, data, part in in_shards(batches):
                if data is None or not len(part):
                    continue
                if data is not held:
                    shard, held = Shard(data), data
                places, marks = key_numbers(part.column(part.schema.names.index("key")))
                yield pa.RecordBatch.from_struct_array(part.to_struct_array().filter(pa.array(shard.holds(places, marks)))).select(names)

        return ordered.mapInArrow(run, lines.schema)

    def frequent_lines(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` whose key at least ``min_docs`` documents hold: candidates, confirmed by the exact counts."""
        often = self.counts.where(F.col("n_docs") >= self.min_docs)
        spread = often.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        return self.candidates(lines).join(spread, ["key", "_salt"], "left_semi")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text without its frequent lines.

        Rows that agree in id and text are alike. Added names that ``docs`` has already get underscores. Only
        digests of lines travel to the shards; the numbers of the dropped lines come back to the texts.
        """
        names = [fresh(docs, n) for n in ("n_lines", "n_dropped", "kept")]
        row_key = digest16(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
        lines = docs.select(row_key.alias("row"), F.posexplode(line_keys(F.col("text"))).alias("line", "value")).where(F.length("value") >= self.min_chars)
        lines = lines.select("row", "line", digest16(F.col("value")).alias("key"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("_salt"))
        drops = self.frequent_lines(lines).groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("_drops"))

        @F.arrow_udf("string")
        def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
            out = []
            for text, gone in zip(texts, drops, strict=True):
                text = text.as_py() or ""
                if gone.is_valid:
                    lines, gone = text.split("\n"), set(gone.as_py())
                    text = "\n".join([line for i, line in enumerate(lines) if i not in gone])
                out.append(text)
            return pa.array(out, pa.string())

        marked = docs.select(F.struct("*").alias("_row"), row_key.alias("row"), F.coalesce("text", F.lit("")).alias("_text")).join(drops, "row", "left")
        n_lines = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1
        n_dropped = F.coalesce(F.size("_drops"), F.lit(0))
        # Only texts that lose lines go through Python.
        changed = F.when(F.col("_drops").isNotNull(), F.col("_text"))
        kept = F.when(F.col("_drops").isNull(), F.col("_text")).otherwise(without(changed, F.col("_drops")))
        added = [c.alias(n) for c, n in zip((n_lines.cast("long"), n_dropped.cast("long"), kept), names, strict=True)]
        return marked.select("_row.*", *added)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` of them hold, as ``LineIndex.apply`` gives them."""
    return LineIndex.empty(docs.sparkSession, min_docs, min_chars).insert(docs).apply(docs)


def op13_lines(spark, sf_dir):
    """One row per document: lines before, lines dropped, digest of the rest. Null and empty texts are one empty line, which stays."""
    left = drop_frequent_lines(documents(spark, sf_dir), 10, 1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT row, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{CAPITALS}', '{SMALL}') AS key
  FROM rows, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
), often AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
), left_over AS (
  SELECT row, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY i) AS kept
  FROM lines WHERE key NOT IN (SELECT key FROM often) GROUP BY row
)
SELECT r.doc_id, len(r.lines)::BIGINT AS n_lines, (len(r.lines) - coalesce(k.n_kept, 0))::BIGINT AS n_dropped,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM rows r LEFT JOIN left_over k USING (row)
"""
