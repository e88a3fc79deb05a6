"""Byte-level BPE as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents, slices, text_bytes, worker_cache

STATES = 100_000  # states of the transducer that a worker keeps; from others it goes on without keeping them,
PASSING = 4_000_000  # and after so many bytes read that way it begins anew
PAIRS = 300_000  # tokens side by side of which a worker remembers whether they may be
PIECES = 400_000  # encoded pieces that a worker keeps


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and their ids from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Transducer:
    """Byte-pair merges compiled into a finite-state transducer.

    After each byte the last token of the encoding so far is unique: of all tokens that end
    here it is the one that may stand after the last token of the text before it, and
    whether two tokens may stand side by side is decided by merging their bytes alone. A
    state holds every place where a token may still be open, with the tokens read since
    all of them agreed; what they agree on is emitted, so the lookahead is at most the
    longest token. States and transitions are made when they are first met; beyond
    STATES a state only passes by, and after PASSING of these all are forgotten and made again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        # The tokens as a tree: each node's children by byte (None at a leaf), and the token that ends at it.
        self.children: list[dict[int, int] | None] = [None]
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.children[node]
                if below is None:
                    below = self.children[node] = {}
                node = below.setdefault(byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.children.append(None)
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.side_by_side: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state << 8 | byte
        self.passed = 0
        self.state_of((-1, ((0, ()),)))

    def state_of(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def merged(self, data: bytes, below: int) -> list[bytes]:
        """Plain merging, the adjacent pair of lowest rank first, by ranks under ``below`` alone."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]  # noqa: B905
            rank, i = min(ranked)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            parts = self.merged(self.text[token], token)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves these two.

        Their merges are taken back, the latest first: the two stay apart unless the parts that
        touch at some moment would merge before the merges already taken back.
        """
        a, b, limit = left, right, len(self.ranks) + 256
        while True:
            if self.ranks.get(self.text[a] + self.text[b], limit) < limit:
                return False
            # Of equal ranks the left one merges first, so it is taken back last.
            of_a, of_b = self.halves_of(a), self.halves_of(b)
            if of_a is not None and (of_b is None or a > b):
                limit, a = a, of_a[1]
            elif of_b is not None:
                limit, b = b + 1, of_b[0]
            else:
                return True

    def move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition: the next state and the tokens that are now certain."""
        state, emitted = self.step(self.states[number], byte)
        made = self.moves[number << 8 | byte] = (self.state_of(state), emitted)
        return made

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        last, open_ = state
        children, token_at = self.children, self.token_at
        still, ended = [], None
        for node, tokens in open_:
            below = children[node]
            if byte not in below:
                continue
            node = below[byte]
            if children[node] is not None:
                still.append((node, tokens))
            token = token_at[node]
            if ended is None and token >= 0:
                before = tokens[-1] if tokens else last
                fits = True
                if before >= 0:
                    key = before << 32 | token
                    fits = self.side_by_side.get(key)
                    if fits is None:
                        if len(self.side_by_side) > PAIRS:
                            self.side_by_side.clear()
                        fits = self.side_by_side[key] = self.may_follow(before, token)
                if fits:
                    ended = (*tokens, token)
        if ended is None:
            raise ValueError("the vocabulary does not hold every byte")
        agreed = len(ended)
        for _, tokens in still:
            agreed = min(agreed, len(tokens))
            while tokens[:agreed] != ended[:agreed]:
                agreed -= 1
            if not agreed:
                break
        emitted = ended[:agreed]
        if agreed:
            last = emitted[-1]
            still = [(node, tokens[agreed:]) for node, tokens in still]
            ended = ended[agreed:]
        still.append((0, ended))
        return (last, tuple(still)), emitted

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one match of the splitting pattern."""
        if self.passed > PASSING:
            self.restart()
        out: list[int] = []
        number, known = 0, self.moves.get
        for at, byte in enumerate(data):
            found = known(number << 8 | byte)
            if found is None:
                if len(self.states) >= STATES:
                    return out + self.passing(self.states[number], data[at:])
                found = self.move(number, byte)
            number, emitted = found
            if emitted:
                out += emitted
        return out + list(self.states[number][1][-1][1])

    def passing(self, state: tuple, data: bytes) -> list[int]:
        """The tokens from a state on, by transitions that are not kept."""
        out: list[int] = []
        self.passed += len(data)
        for byte in data:
            state, emitted = self.step(state, byte)
            if emitted:
                out += emitted
        return out + list(state[1][-1][1])


def cuts(text: str) -> list[str]:
    """The text in pieces that the splitting pattern never joins.

    No match goes on from anything else to white space, so a text may be cut before a
    blank between two other characters.
    """
    parts = text.split(" ")
    out, now = [], parts[0]
    for part in parts[1:]:
        if part and now and not now[-1].isspace() and not part[0].isspace():
            out.append(now)
            now = " " + part
        else:
            now += " " + part
    out.append(now)
    return out


class PieceEncoder:
    """Encodes whole texts piece by piece to 32-bit ids; pieces seen before are looked up.

    ``encode_pieces`` gives the ids of pieces, each encoded on its own, as little-endian bytes.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], most: int = PIECES):
        self.encode_pieces, self.most = encode_pieces, most
        self.after: dict[str, bytes] = {}  # by what follows a blank

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        first, rest = parts[0], parts[1:]
        found = list(map(self.after.get, rest))
        if None in found or first[-1:].isspace():
            new = {p for p, f in zip(rest, found, strict=True) if f is None}
            # A part kept before is neither empty nor has white space at its ends.
            if first[-1:].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                return b"".join(self.encode_pieces(cuts(text)))
            if len(self.after) > self.most:
                self.after.clear()
            ordered = sorted(new)
            made = dict(zip(ordered, self.encode_pieces([" " + p for p in ordered]), strict=True))
            self.after.update((p, ids) for p, ids in made.items() if len(p) <= 64)
            found = [made[p] if f is None else f for p, f in zip(rest, found, strict=True)]
        return self.encode_pieces([first])[0] + b"".join(found)


def transducing(ranks: dict[bytes, int], pattern: str) -> PieceEncoder:
    """An encoder by the transducer; matches of the pattern seen before are looked up as well."""
    transducer, matches, seen = Transducer(ranks), regex.compile(pattern), {}

    def ids_of(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            ids = b""
            for match in matches.findall(piece):
                known = seen.get(match)
                if known is None:
                    known = ids_of(*transducer.encode(match.encode()))
                    if len(seen) > PIECES:
                        seen.clear()
                    if len(match) <= 64:
                        seen[match] = known
                ids += known
            out.append(ids)
        return out

    return PieceEncoder(encode)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """The UTF-8 state machine. A state: bytes still to come, and the range of the next one; None: broken."""
    rest, low, high = state
    if rest:
        return (rest - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


def unfinished(data: bytes) -> int:
    """How many bytes at the end begin a character that more bytes may finish."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead < 0x80:
            return 0
        if lead >= 0xC0:
            state: tuple[int, int, int] | None = (0, 0, 0)
            for byte in data[-back:]:
                state = utf8_step(state, byte) if state is not None else None
            return back if state is not None and state[0] else 0
    return 0


def decode_stream(ids: Iterable[int], table: list[bytes], step: int = 8192) -> Iterator[bytes]:
    """The bytes of ``ids`` in parts that never cut a character; a broken end comes last as it is."""
    held, rest = b"", iter(ids)
    while now := list(islice(rest, step)):
        data = held + b"".join(map(table.__getitem__, now))
        keep = unfinished(data)
        held = data[len(data) - keep :]
        yield data[: len(data) - keep]
    yield held


def worker_encoder(data: bytes, pattern: str) -> PieceEncoder:
    kept = worker_cache("bpe")
    key = (hashlib.md5(data).digest(), pattern)
    if key not in kept:
        kept[key] = transducing(read_ranks(data), pattern)
    return kept[key]


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def bpe_encode(docs: DataFrame, ranks_file: str, pattern: str, name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text as array<int>; null and empty texts have none.

    The rank file is read on the driver and broadcast: a vocabulary is a few MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_file(ranks_file))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(shared.value, pattern)
        for batch in batches:
            yield encoded(batch, encoder)

    return docs.withColumn(name, encode(F.col("text")))


def encoded(texts: pa.Array, encoder: PieceEncoder) -> pa.ListArray:
    ids, ends = [], [0]
    for text in texts.to_pylist():
        ids.append(np.frombuffer(encoder.encode(text or ""), dtype="<i4"))
        ends.append(ends[-1] + len(ids[-1]))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def worker_table(data: bytes) -> list[bytes]:
    """The bytes of each token by its id."""
    kept = worker_cache("bpe-table")
    key = hashlib.md5(data).digest()
    if key not in kept:
        ranks = read_ranks(data)
        kept[key] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            kept[key][rank] = token
    return kept[key]


def decoded(lists: pa.ListArray, table: list[bytes]) -> pa.Array:
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    rows = zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)
    return pa.array([b"".join(decode_stream(flat[a:b].tolist(), table)) if ok else None for a, b, ok in rows], pa.binary())


def bpe_decode(df: DataFrame, ids: str | Column, ranks_file: str, name: str = "decoded") -> DataFrame:
    """``df`` with the bytes that an array of token ids stands for; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(read_file(ranks_file))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = worker_table(shared.value)
        for batch in batches:
            yield decoded(batch, table)

    return df.withColumn(name, decode(F.col(ids) if isinstance(ids, str) else ids))


def bpe_round_trip(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row, encoded and decoded by the same worker.

    As two Python steps of one plan they would take two workers a core, each with a transducer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_file(ranks_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(shared.value, pattern), worker_table(shared.value)
        for batch in slices(batches, 256):
            ids = encoded(batch.column(1), encoder)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded(ids, table)], ["doc_id", "ids", "decoded"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def with_digests(df: DataFrame, ids: str, decoded: str) -> list[Column]:
    text = F.array_join(F.col(ids).cast("array<string>"), " ")
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(text, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


RANKS = "byte_bpe_50k.tiktoken"


def op10_bpe(spark, sf_dir):
    both = bpe_round_trip(documents(spark, sf_dir), public_file(RANKS), public_pattern())
    return both.select("doc_id", *with_digests(both, "ids", "decoded"))


def tokenised(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row: its ids, and whether they decode to its bytes.

    The comparison is made where the text is, so neither texts nor decoded bytes leave the worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_file(ranks_file or public_file(RANKS)))
    pattern = pattern or public_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(shared.value, pattern), worker_table(shared.value)
        for batch in slices(batches, 256):
            ids = encoded(batch.column(1), encoder)
            back, texts = decoded(ids, table).to_pylist(), text_bytes(batch.column(1))
            same = pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())
            counts = ids.value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, ids, same], ["doc_id", "n_tokens", "ids", "round_trip"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
