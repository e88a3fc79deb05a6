"""Two tokenizers' tokens of the same bytes, aligned by merge-path partitioning of their ends."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.bpe import public_file, public_pattern, read_file
from gaugework.llm.common import documents, worker_cache
from gaugework.session import cut_lineage

PIECE = 64  # merge steps of an independent piece
BATCH_DOCS = 1024  # documents aligned at once
BATCH_BYTES = 1 << 20  # text after which a batch is closed
BUCKETS = 64  # parts that pairs are dealt to
SLICE = 1 << 14  # batches that share a copy of a bucket's totals
SPREAD = 40_503  # multiplier that deals pairs to buckets
FLUSH = 1 << 20  # distinct pairs after which a task hands its counts on


class Vocabulary:
    """The tokens' bytes end to end, and where each begins, by id."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes of all ``ids``."""
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.bytes[np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))].tobytes()


class Tokenizer:
    """Ids of whole texts, each behind a blank, by one library."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode_texts, self.vocabulary = encode, Vocabulary(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; none where they do not give its bytes back."""
        ids = [np.array(i, dtype=np.int32) for i in self.encode_texts(texts)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(self.vocabulary.lengths[flat])])[np.cumsum([0, *map(len, ids)])].tolist()
        back = self.vocabulary.text(flat)
        same = [back[low:high] == b" " + text.encode() for low, high, text in zip(ends, ends[1:], texts, strict=False)]
        return [i if s else i[:0] for i, s in zip(ids, same, strict=True)]


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of byte-level entries: printable Latin-1 characters stand for themselves, 256 onwards for the rest."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for entry, number in vocabulary.items():
        tokens[number] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return tokens


def merged_ids(model: dict) -> list[int]:
    """The id of each merge's token, in the order of the merges."""
    return [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]


def byte_tokenizer(data: bytes) -> Tokenizer:
    """The byte-level BPE of a tokenizers file; strings of special tokens are ordinary text.

    Where ids are the ranks of the merges, the tiktoken library encodes with the same vocabulary and pattern five times
    as fast (both agree on every code point); a text it cannot take, and other files, go to the tokenizers library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer as Library

    library, described = Library.from_str(data.decode()), json.loads(data)
    library.encode_special_tokens = True
    tokens = byte_level_tokens(library.get_vocab(with_added_tokens=True))

    def slow(text: str) -> list[int]:
        return library.encode(" " + text, add_special_tokens=False).ids

    splits = described.get("pre_tokenizer") or {}
    usual = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
    merged = merged_ids(described["model"])
    if not usual or described.get("normalizer") or described["model"].get("dropout") or merged != sorted(set(merged)):
        return Tokenizer(lambda texts: [slow(t) for t in texts], tokens)
    import tiktoken

    ranks = {tokens[i]: i for i in [*merged, *(i for i, t in enumerate(tokens) if len(t) == 1)]}
    quick = tiktoken.Encoding("file", pat_str=public_pattern(), mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        try:
            return quick.encode_ordinary(" " + text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # noqa: BLE001  a panic of the library is no Exception
            return slow(text)

    return Tokenizer(lambda texts: [encode(t) for t in texts], tokens)


def piece_tokenizer(data: bytes) -> Tokenizer:
    """The sentencepiece library, which puts the blank in front itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokens = []
    for number in range(library.get_piece_size()):
        piece = library.id_to_piece(number)
        tokens.append(bytes([int(piece[3:5], 16)]) if library.is_byte(number) else piece.replace("▁", " ").encode())
    return Tokenizer(lambda texts: library.encode(texts, num_threads=1), tokens)


def kept_tokenizer(kind: str, data: bytes) -> Tokenizer:
    kept = worker_cache("alignment")
    key = (kind, zlib.crc32(data))
    if key not in kept:
        kept[key] = {"byte": byte_tokenizer, "piece": piece_tokenizer}[kind](data)
    return kept[key]


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each diagonal, how many of the first ``at`` ends of the merged order are of A (A first among equals)."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        taken = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(at - middle - 1, 0, len(b) - 1)]
        low = np.where(open_ & taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A indexes, B indexes) of overlapping tokens in order, and which A and B tokens end a group.

    ``a`` and ``b`` are the ascending ends of tokens that cover the same bytes. The merge of both is cut on
    diagonals into pieces of equal work; a binary search finds where each begins, and the pieces are then
    merged independently, one lane each. A group that a cut goes through is stitched by the ends
    alone: a piece marks ends, and groups are counted over the marks of all pieces.
    """
    steps = len(a) + len(b)
    if not steps:
        none, no = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        return none, none, no, no
    first = np.arange(0, steps, PIECE)
    i = diagonals(a, b, first)
    j = first - i
    far = np.iinfo(np.int64).max
    ends_a, ends_b = np.append(a, far), np.append(b, far)
    starts_a, starts_b = np.concatenate([[0], a]), np.concatenate([[0], b])
    last_a, last_b = np.zeros(len(a) + 1, dtype=bool), np.zeros(len(b) + 1, dtype=bool)
    link_a = np.full((PIECE, len(first)), -1, dtype=np.int64)
    link_b = np.empty((PIECE, len(first)), dtype=np.int64)
    for step in range(PIECE):
        end_a, end_b = ends_a[i], ends_b[j]
        overlap = np.maximum(starts_a[i], starts_b[j]) < np.minimum(end_a, end_b)
        overlap &= (i < len(a)) & (j < len(b))
        link_a[step] = np.where(overlap, i, -1)
        link_b[step] = j
        both = overlap & (end_a == end_b)
        last_a[i[both]] = True
        last_b[j[both]] = True
        take = end_a <= end_b
        # The last lane may be at its end: both indexes then stay behind the last token.
        i = np.minimum(i + take, len(a))
        j = np.minimum(j + ~take, len(b))
    link_a, link_b = link_a.T.reshape(-1), link_b.T.reshape(-1)
    found = link_a >= 0
    return link_a[found], link_b[found], last_a[:-1], last_b[:-1]


class Aligned:
    """A batch of documents laid end to end and aligned as one: ids, links and groups, and where each document's begin."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], one: Vocabulary, two: Vocabulary):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.concatenate(ids) if ids else np.zeros(0, np.int32) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(one.lengths[self.a]), np.cumsum(two.lengths[self.b])
        self.link_a, self.link_b, self.last_a, self.last_b = merge_path(ends_a, ends_b)
        docs = np.arange(len(ids_a))
        self.doc_a = np.repeat(docs, self.n_a)
        self.link_doc = self.doc_a[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=len(docs))
        self.n_groups = np.bincount(self.doc_a[self.last_a], minlength=len(docs))
        self.width = max(one.size, two.size)

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per document."""
        # The place of a token among all: those of its kind before, and the other kind's of earlier groups.
        group_a = np.cumsum(self.last_a) - self.last_a
        group_b = np.cumsum(self.last_b) - self.last_b
        groups = int(self.last_a.sum())
        to_a, to_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (group_a, group_b))
        place_a = np.arange(len(self.a)) + to_b[group_a]
        place_b = np.arange(len(self.b)) + to_a[group_b + 1]
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # An id with what follows it: a comma, a bar, a semicolon.
        code[place_a] = self.a + self.width * np.where(self.last_a, 1, 0)
        code[place_b] = self.b + self.width * np.where(self.last_b, 2, 0)
        written = list(map(marked_numbers(self.width).__getitem__, code.tolist()))
        out, start = [], 0
        for end in np.cumsum(self.n_a + self.n_b).tolist():
            out.append("".join(written[start:end])[:-1])
            start = end
        return out


def marked_numbers(width: int) -> list[str]:
    """The ids below ``width`` followed by a comma, then by a bar, then by a semicolon."""
    kept = worker_cache("alignment-numbers")
    if width not in kept:
        kept[width] = [f"{n}{mark}" for mark in ",|;" for n in range(width)]
    return kept[width]


def doc_pairs(made: Aligned, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, links) of every document's distinct pairs, ascending; a pair is B id times ``span`` plus A id."""
    pair = made.b[made.link_b].astype(np.int64) * span + made.a[made.link_a]
    docs = max(1, len(made.n_a))
    both, links = np.unique(pair * docs + made.link_doc, return_counts=True)
    return both // docs, both % docs, links


def planes(pair: np.ndarray, doc: np.ndarray, links: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Ascending (pair, document, links) as: pairs, documents of each, documents, links. Small numbers in planes of one kind pack well."""
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(at, len(pair)))
    return pair[at].astype("<u8").tobytes(), sizes.astype("<u2").tobytes(), doc.astype("<u2").tobytes(), links.astype("<u4").tobytes()


ALIGNED = (
    "kind int, batch long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "bucket int, pairs binary, sizes binary, docs binary, links binary"
)
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int32(), *[pa.binary()] * 4]
DOCS, PAIRS, COUNTS = 0, 1, 2


def record(columns: dict[str, list]) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    arrays = [pa.array(columns[n], k) if n in columns else pa.nulls(rows, k) for n, k in zip(NAMES, KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def bucket_of(pair: np.ndarray, buckets: int) -> np.ndarray:
    return ((pair * SPREAD & 0xFFFFFFFF) >> 7) % buckets


class PairCounts:
    """A task's counts of pairs, added up before they are handed on."""

    def __init__(self):
        self.pairs, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray, links: np.ndarray) -> None:
        both = np.concatenate([self.pairs, pairs])
        order = np.argsort(both, kind="stable")
        both, links = both[order], np.concatenate([self.sums, links])[order]
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.pairs, self.sums = both[at], np.add.reduceat(links, at) if len(at) else links

    def rows(self) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.pairs), 65_536):
            data = [x[low : low + 65_536].astype("<u8").tobytes() for x in (self.pairs, self.sums)]
            yield record({"kind": [COUNTS], "pairs": [data[0]], "links": [data[1]]})
        self.__init__()


def align(docs: DataFrame, byte_file: str, piece_file: str, buckets: int) -> DataFrame:
    """Rows of three kinds: a document's own figures, a batch's pairs per bucket, and a task's counts of pairs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_file(byte_file), read_file(piece_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = kept_tokenizer("byte", shared.value[0]), kept_tokenizer("piece", shared.value[1])
        span = one.vocabulary.size
        part, number, counts = TaskContext.get().partitionId(), 0, PairCounts()
        held, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            texts = [t for _, t in held]
            pairs = [(a, b) if t and len(a) and len(b) else (a[:0], b[:0]) for t, a, b in zip(texts, one.encode(texts), two.encode(texts), strict=True)]
            made = Aligned([a for a, _ in pairs], [b for _, b in pairs], one.vocabulary, two.vocabulary)
            batch = part << 32 | number
            some = (made.n_a > 0).tolist()
            digests = [hashlib.sha256(t.encode()).hexdigest() if s else "" for t, s in zip(made.group_texts(), some, strict=True)]
            rows = len(held)
            figures = {"n_a": made.n_a, "n_b": made.n_b, "n_groups": made.n_groups, "n_links": made.n_links}
            own = {"kind": [DOCS] * rows, "batch": [batch] * rows, "idx": list(range(rows)), "doc_id": [i for i, _ in held]}
            yield record(own | figures | {"groups_sha256": digests})
            pair, doc, links = doc_pairs(made, span)
            if not len(pair):
                return
            counts.add(pair, links)
            bucket = bucket_of(pair, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, pair, doc, links = bucket[order], pair[order], doc[order], links[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            laid = [planes(pair[l:h], doc[l:h], links[l:h]) for l, h in zip(cuts, np.append(cuts[1:], len(pair)), strict=True)]
            named = dict(zip(("pairs", "sizes", "docs", "links"), map(list, zip(*laid, strict=True)), strict=True))
            yield record({"kind": [PAIRS] * len(cuts), "batch": [batch] * len(cuts), "bucket": bucket[cuts].tolist()} | named)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, text or ""))
                size += len(held[-1][1])
                if len(held) >= BATCH_DOCS or size >= BATCH_BYTES:
                    yield from close()
                    number, held, size = number + 1, [], 0
                    if len(counts.pairs) > FLUSH:
                        yield from counts.rows()
        if held:
            yield from close()
        yield from counts.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_totals(rows: DataFrame) -> DataFrame:
    """(pair, count): how many links of the corpus hold each pair of ids."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = [pa.array(np.frombuffer(x, dtype="<u8").astype(np.int64)) for x in (pairs, links)]
                yield pa.RecordBatch.from_arrays(columns, ["pair", "n"])

    partial = rows.where(F.col("kind") == COUNTS).select("pairs", "links").mapInArrow(unpacked, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("count"))


def runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The slices of a batch over which its first ``keys`` columns do not change."""
    columns = np.stack([batch.column(c).to_numpy() for c in range(keys)])
    cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low < high:
            yield tuple(columns[:, low].tolist()), batch.slice(low, high - low)


def weighed(rows: DataFrame, totals: DataFrame, slices: int, buckets: int) -> DataFrame:
    """Per batch and bucket, what its pairs add to its documents' ``n_best`` and ``count_sum``, packed."""
    hashed = F.shiftright((F.col("pair") * SPREAD).bitwiseAND(0xFFFFFFFF), 7) % buckets
    copies = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    heads = totals.select(hashed.cast("int").alias("bucket"), copies.alias("slice"), F.lit(0).alias("kind"), F.col("pair").alias("total_pair"), "count", "best")
    slice_ = F.pmod(F.xxhash64("batch"), F.lit(slices)).cast("int").alias("slice")
    packed = rows.where(F.col("kind") == PAIRS).select("bucket", slice_, "kind", "batch", "pairs", "sizes", "docs", "links")
    both = heads.unionByName(packed, allowMissingColumns=True).repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "kind")
    named = ["bucket", "slice", "kind", "total_pair", "count", "best", "batch", "pairs", "sizes", "docs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for batch in batches:
            for key, part in runs(batch, 2):
                if key != now:
                    now, parts, table = key, [], None
                heads_ = int((part.column(2).to_numpy() == 0).sum())
                if heads_:
                    parts.append([part.column(c).slice(0, heads_).to_numpy(zero_copy_only=False) for c in (3, 4, 5)])
                if heads_ == len(part):
                    continue
                if table is None:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    order = np.argsort(columns[0])
                    table, parts = [c[order] for c in columns], []
                rest, out = part.slice(heads_), []
                for number, *data in zip(*[rest.column(c).to_pylist() for c in range(6, 11)], strict=True):
                    pairs, sizes, of, links = (np.frombuffer(x, dtype=t).astype(np.int64) for x, t in zip(data, ("<u8", "<u2", "<u2", "<u4"), strict=True))
                    at = np.searchsorted(table[0], pairs)
                    count, good = (np.repeat(table[c][at], sizes) for c in (1, 2))
                    seen, inside = np.unique(of, return_inverse=True)
                    sums = np.zeros((2, len(seen)), dtype=np.int64)
                    np.add.at(sums[0], inside, links * good)
                    np.add.at(sums[1], inside, links * count)
                    out.append((number, seen.astype("<u2").tobytes(), sums[0].astype("<i8").tobytes(), sums[1].astype("<i8").tobytes()))
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["batch", "docs", "best", "sums"])

    return both.select(*named).mapInArrow(run, "batch long, docs binary, best binary, sums binary")


FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Every document's own figures with the sums over its batch's parts, which come first."""
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    docs = rows.where(F.col("kind") == DOCS).select("batch", F.lit(1).alias("step"), "idx", *own)
    both = parts.withColumn("step", F.lit(0)).unionByName(docs, allowMissingColumns=True)
    both = both.repartition("batch").sortWithinPartitions("batch", "step", "idx").select("batch", "step", "docs", "best", "sums", "idx", *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, sums = None, None, None
        for batch in batches:
            for (number, step), part in runs(batch, 2):
                if number != now:
                    now, best, sums = number, *np.zeros((2, BATCH_DOCS), dtype=np.int64)
                if step == 0:
                    for docs_, *added in zip(*[part.column(c).to_pylist() for c in (2, 3, 4)], strict=True):
                        at = np.frombuffer(docs_, dtype="<u2")
                        best[at] += np.frombuffer(added[0], dtype="<i8")
                        sums[at] += np.frombuffer(added[1], dtype="<i8")
                    continue
                at = part.column(5).to_numpy()
                columns = [*[part.column(c) for c in range(6, 11)], pa.array(best[at]), pa.array(sums[at]), part.column(11)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FIGURES.split(", ")])

    return both.mapInArrow(run, FIGURES)


def alignment(docs: DataFrame, byte_file: str, piece_file: str, buckets: int = BUCKETS, slice_batches: int = SLICE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Texts that are null, empty, or that a tokenizer does not give back byte for byte have no tokens: zeros and an empty
    digest. Repeated rows and null ids are rows of their own; an empty table stays empty; other columns take no part.

    A pair's count is the corpus's, so a document's distinct pairs meet the totals: per batch of documents and
    bucket of pairs they travel as one packed row, behind a copy of the bucket's totals, to a task; a bucket has one such task
    for every ``slice_batches`` batches. Neither number changes results. No table of pairs is broadcast.
    """
    span = byte_tokenizer(read_file(byte_file)).vocabulary.size
    rows = cut_lineage(align(docs, byte_file, piece_file, buckets), "aligned")
    totals = cut_lineage(pair_totals(rows), "pair-totals").withColumn("b", F.expr(f"pair div {span}"))
    best = totals.groupBy("b").agg(F.max("count").alias("most"))
    told = totals.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    batches = rows.where((F.col("kind") == DOCS) & (F.col("idx") == 0)).count()
    return summed(rows, weighed(rows, told, 1 + batches // slice_batches, buckets))


def op12_align(spark, sf_dir):
    """One row per document; nulls, empties and repeats as ``alignment`` says."""
    return alignment(documents(spark, sf_dir), public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"))
