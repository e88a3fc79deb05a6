"""Token ids in files: an adaptive context-mixing range coder over independent blocks."""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.bpe import PieceEncoder, cuts, public_file, read_file
from gaugework.llm.common import documents, settled, slices, worker_cache
from gaugework.session import scratch_path

BLOCK = 2048  # ids of a block; each is coded on its own, from a fresh model
SEGMENT = 1 << 22  # ids after which a task closes a segment
SLOTS = 9  # bits of a context's place in the tables of predicted ids
TOTAL = 1 << 12  # denominator of the coder's probabilities
LEAST = 32  # and the least one of order 2
MOST_ID = 1 << 28
HEAD = "<4sIIQB"  # magic, documents, blocks, ids, bytes of a literal
BLOCK_HEAD = "<IIII"  # ids, words of 32 bits, literals, crc32 of the ids
MAGIC = b"GWT2"
FLOOR = 1 << 30  # a lane lays down a word when its span is below
PIECES = 800_000  # encoded pieces that a worker keeps
JOINED = 256  # pieces that the library encodes as one text
TEXTS = 1 << 17  # characters of the texts whose pieces are looked up together
CLOSING = '.,;:!?"$%&#*)]}'  # what may follow a word without changing its ids

# Logistic mixing in whole numbers, so that every machine decodes alike: probabilities in
# 4096ths, their logits in 256ths.
_SQUASH = np.array([min(TOTAL - LEAST, max(LEAST, round(TOTAL / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int32)
# How a state moves: 0 to 7 after a hit, and after a miss.
_MOVE = np.array([1, 1, 1, 1, 1, 1, 1, 0, 0, -1, -1, -2, -2, -3, -3, -4], dtype=np.int32)
# What each order's state says at first: the logit that order 2 is right, and the chance of an order, given that those above missed.
_LOGITS = ((-4, -1, 0, 1, 1, 2, 2, 3), (0,) * 8, (0,) * 8)
_CHANCES = ((0,) * 8, (0.02, 0.25, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (0.02,) * 8)
_HASH = [np.array(k, dtype=np.uint32) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


class Predictor:
    """Predicted ids and their probabilities, for many blocks in step.

    Order 2 and order 1 keep, per context, the id that followed and how often it held;
    order 0 does so for the block. The probability that order 2 is right is mixed from what each
    order's state says about it, by logits that learn; those of the orders
    below are counted per state, given that the ones above missed. All three orders are rows of
    the same arrays, and results go to arrays made once: a call of NumPy costs more than its sums.
    """

    def __init__(self, lanes: int):
        def ints(*shape: int) -> np.ndarray:
            return np.zeros(shape, dtype=np.int32)

        def longs(*shape: int) -> np.ndarray:
            return np.zeros(shape, dtype=np.int64)

        self.lanes, self.rows = lanes, np.arange(lanes)
        self.table = ints((2 << SLOTS) * lanes + lanes)  # id << 3 | held; order 0 comes last
        self.at_slot = np.arange(2 * lanes).reshape(2, lanes) << SLOTS
        self.slots = longs(3, lanes)
        self.slots[2] = (2 * lanes << SLOTS) + self.rows
        self.entry, self.held, self.fresh = ints(3, lanes), longs(3, lanes), np.zeros((3, lanes), dtype=bool)
        # Per lane, order and state: the logit in 2048ths, and below it the chance in 16 bits.
        first = [[(w << 27) + round(c * 65_535) for w, c in zip(*row, strict=True)] for row in zip(_LOGITS, _CHANCES, strict=True)]
        self.state = np.repeat(np.array(first, dtype=np.int32), lanes, axis=0).reshape(-1)
        self.at_state = np.arange(3 * lanes).reshape(3, lanes) << 3
        self.keys, self.found, self.chance = longs(3, lanes), ints(3, lanes), ints(2, lanes)
        self.ids = ints(4, lanes)  # of orders 2, 1, 0; the last row is for a literal
        self.cumulated = ints(5, lanes)
        self.cumulated[4] = TOTAL
        self.begins, self.ends = self.cumulated.reshape(-1)[: 4 * lanes], self.cumulated.reshape(-1)[lanes:]
        self.last, self.older, self.hashed = (np.zeros(n, dtype=np.uint32) for n in (lanes, lanes, (2, lanes)))
        self.x, self.y, self.logit = ints(lanes), ints(lanes), longs(lanes)
        self.two, self.three, self.moves = ints(2, lanes), ints(3, lanes), longs(3, lanes)
        self.right, self.wrong = np.zeros((2, lanes), dtype=bool), np.zeros((3, lanes), dtype=bool)
        self.symbol, self.at = np.zeros(lanes, dtype=np.uint8), longs(lanes)
        self.begin, self.size = ints(lanes), ints(lanes)

    def predict(self) -> np.ndarray:
        """Cumulative frequencies (5, lanes) of: order 2 right, order 1, order 0, none."""
        hashed, x, y, cumulated, found, entry = self.hashed, self.x, self.y, self.cumulated, self.found, self.entry
        np.multiply(self.last, _HASH[0], out=hashed[1])
        np.bitwise_xor(hashed[1], self.older, out=hashed[0])
        np.multiply(hashed[0], _HASH[1], out=hashed[0])
        np.right_shift(hashed, 32 - SLOTS, out=hashed)
        np.add(self.at_slot, hashed, out=self.slots[:2])
        self.table.take(self.slots, out=entry, mode="clip")
        np.right_shift(entry, 3, out=self.ids[:3])
        np.bitwise_and(entry, 7, out=self.held)
        np.add(self.at_state, self.held, out=self.keys)
        self.state.take(self.keys, out=found, mode="clip")
        np.bitwise_and(found[1:], 65_535, out=self.chance)
        np.add(found[0], found[1], out=x)
        np.add(x, found[2], out=x)
        np.right_shift(x, 19, out=x)
        np.add(x, 2047, out=self.logit)
        _SQUASH.take(self.logit, out=cumulated[1], mode="clip")
        # Each symbol has one of TOTAL at least.
        np.subtract(TOTAL - 3, cumulated[1], out=x)
        np.multiply(x, self.chance[0], out=y)
        np.right_shift(y, 16, out=y)
        np.subtract(x, y, out=x)
        np.add(y, cumulated[1], out=cumulated[2])
        np.add(cumulated[2], 1, out=cumulated[2])
        np.multiply(x, self.chance[1], out=y)
        np.right_shift(y, 16, out=y)
        np.add(y, cumulated[2], out=cumulated[3])
        np.add(cumulated[3], 1, out=cumulated[3])
        return cumulated

    def compare(self, ids: np.ndarray) -> np.ndarray:
        """Which orders are wrong."""
        return np.not_equal(self.ids[:3], ids, out=self.wrong)

    def pick(self, missed: np.ndarray) -> None:
        """Begin and size of the symbols; ``missed`` (3, lanes): order 2, also order 1, all of them."""
        flags = missed.view(np.uint8)
        np.add(flags[0], flags[1], out=self.symbol)
        np.add(self.symbol, flags[2], out=self.symbol)
        np.multiply(self.symbol, self.lanes, out=self.at, dtype=np.int64)
        np.add(self.at, self.rows, out=self.at)
        self.begins.take(self.at, out=self.begin, mode="clip")
        self.ends.take(self.at, out=self.size, mode="clip")
        np.subtract(self.size, self.begin, out=self.size)

    def update(self, ids: np.ndarray, missed: np.ndarray) -> None:
        """Learn the ids that came; ``compare`` has been called with them."""
        x, two, three, found, entry = self.x, self.two, self.three, self.found, self.entry
        # The error of the probability of order 2, none where it can go no further.
        np.multiply(missed[0], 2 * LEAST - TOTAL, out=x, dtype=np.int32)
        np.subtract(x, self.cumulated[1], out=x)
        np.add(x, TOTAL - LEAST, out=x)
        np.right_shift(x, 2, out=x)
        np.left_shift(x, 16, out=x)
        np.add(found, x, out=found)
        np.bitwise_xor(missed[:2], missed[1:], out=self.right)
        np.multiply(self.right, 65_535, out=two, dtype=np.int32)
        np.subtract(two, self.chance, out=two)
        np.right_shift(two, 5, out=two)
        np.multiply(two, missed[:2], out=two)
        np.add(found[1:], two, out=found[1:])
        self.state[self.keys] = found
        # What held is held more, what missed less; a state that was 0 takes the new id.
        np.multiply(self.wrong, 8, out=self.moves, dtype=np.int64)
        np.add(self.moves, self.held, out=self.moves)
        np.equal(self.moves, 8, out=self.fresh)
        _MOVE.take(self.moves, out=three, mode="clip")
        np.add(entry, three, out=entry)
        np.left_shift(ids, 3, out=x)
        np.add(x, 1, out=x)
        np.subtract(x, entry, out=three)
        np.multiply(three, self.fresh, out=three)
        np.add(entry, three, out=entry)
        self.table[self.slots] = entry
        np.multiply(self.last, _HASH[2], out=self.older)
        np.copyto(self.last, ids, casting="unsafe")


class RangeEncoder:
    """Range coders of 62 bits for many blocks in step. Words of 32 bits are kept as they come; carries are added at the end."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.span = np.full(lanes, (1 << 62) - 1, dtype=np.int64)
        self.part = np.zeros(lanes, dtype=np.int64)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def put(self, begin: np.ndarray, size: np.ndarray) -> None:
        np.right_shift(self.span, 12, out=self.part)
        np.multiply(self.part, size, out=self.span)
        np.multiply(self.part, begin, out=self.part)
        np.add(self.low, self.part, out=self.low)

    def settle(self) -> None:
        """Lay down words; needed after every second symbol, which takes 24 bits at most."""
        at = np.flatnonzero(self.span < FLOOR)
        if len(at):
            low = self.low[at]
            self.lanes.append(at.astype(np.int32))
            self.words.append(low >> 30)
            self.low[at] = (low & (FLOOR - 1)) << 32
            self.span[at] <<= 32

    def finish(self) -> tuple[bytes, np.ndarray]:
        """All words, lane after lane, and how many each lane has."""
        self.settle()
        self.lanes.append(np.arange(len(self.low), dtype=np.int32))
        self.words.append((self.low + (FLOOR - 1)) >> 30)
        lanes = np.concatenate(self.lanes)
        words = np.concatenate(self.words)[np.argsort(lanes, kind="stable")]
        while len(over := np.flatnonzero(words >> 32)):
            words[over] -= 1 << 32
            words[over - 1] += 1  # never of another lane: a lane's first word has no carry
        return words.astype("<u4").tobytes(), np.bincount(lanes, minlength=len(self.low))


class RangeDecoder:
    def __init__(self, payloads: list[bytes]):
        words = np.frombuffer(b"".join([p + bytes(8) for p in payloads]), dtype="<u4").astype(np.int64)
        sizes = np.array([len(p) // 4 + 2 for p in payloads], dtype=np.int64)
        at = np.cumsum(sizes) - sizes
        self.code = words[at] << 30 | words[at + 1] >> 2
        # The code has 62 bits, so what follows begins two bits before a word does.
        self.following = (words[:-1] & 3) << 30 | words[1:] >> 2
        self.at = at + 1
        self.span = np.full(len(payloads), (1 << 62) - 1, dtype=np.int64)
        self.part = np.zeros(len(payloads), dtype=np.int64)
        self.bounds = np.zeros((3, len(payloads)), dtype=np.int64)

    def peek(self, cumulated: np.ndarray, missed: np.ndarray) -> None:
        """Which of the bounds between symbols the code has reached."""
        np.right_shift(self.span, 12, out=self.part)
        np.multiply(cumulated[1:4], self.part, out=self.bounds)
        np.less_equal(self.bounds, self.code, out=missed)

    def take(self, begin: np.ndarray, size: np.ndarray) -> None:
        np.multiply(self.part, size, out=self.span)
        np.multiply(self.part, begin, out=self.part)
        np.subtract(self.code, self.part, out=self.code)

    def settle(self) -> None:
        need = np.flatnonzero(self.span < FLOOR)
        if len(need):
            self.span[need] <<= 32
            place = self.at[need]
            self.code[need] = self.code[need] << 32 | self.following.take(place, mode="clip")
            self.at[need] = place + 1


def block_lengths(n: int) -> list[int]:
    return [BLOCK] * (n // BLOCK) + [n % BLOCK] * (n % BLOCK > 0)


def encode_blocks(ids: np.ndarray, width: int) -> list[bytes]:
    """Each BLOCK of ids as header, coded words and literals of ``width`` bytes.

    An id is an order's prediction or a literal. Literals lie beside the words, as they are. Ids 0 follow a
    short last block until all blocks are done; readers leave them out.
    """
    lengths = block_lengths(len(ids))
    if not lengths:
        return []
    lanes, longest = len(lengths), lengths[0]
    # Rows a little longer than a power of two, which turn faster.
    square = np.zeros((lanes, longest + 16), dtype=np.int32)[:, :longest]
    full = len(ids) // longest
    square[:full] = ids[: full * longest].reshape(full, longest)
    square[full:, : len(ids) - full * longest] = ids[full * longest :]
    steps = np.ascontiguousarray(square.T)
    literal = np.zeros((longest, lanes + 64), dtype=bool)[:, :lanes]
    model, coder, missed = Predictor(lanes), RangeEncoder(lanes), np.zeros((3, lanes), dtype=bool)
    for step, now in enumerate(steps):
        model.predict()
        wrong = model.compare(now)
        np.copyto(missed[0], wrong[0])
        np.bitwise_and(wrong[1], missed[0], out=missed[1])
        np.bitwise_and(wrong[2], missed[1], out=missed[2])
        np.copyto(literal[step], missed[2])
        model.pick(missed)
        coder.put(model.begin, model.size)
        if step & 1:
            coder.settle()
        model.update(now, missed)
    words, counts = coder.finish()
    by_lane = np.ascontiguousarray(literal.T)
    literals = square.astype(f"<u{width}", order="C").reshape(-1)[by_lane.reshape(-1)].tobytes()
    little = memoryview(np.ascontiguousarray(ids, dtype="<i4")).cast("B")
    out, at, word, place = [], 0, 0, 0
    for n, coded, plain in zip(lengths, counts.tolist(), by_lane.sum(axis=1).tolist(), strict=True):
        head = struct.pack(BLOCK_HEAD, n, coded, plain, zlib.crc32(little[4 * at : 4 * (at + n)]))
        out.append(head + words[4 * word : 4 * (word + coded)] + literals[width * place : width * (place + plain)])
        at, word, place = at + n, word + coded, place + plain
    return out


def decode_blocks(blocks: list[bytes], width: int) -> np.ndarray:
    """The ids of blocks of one segment; a wrong checksum is an error."""
    heads = [struct.unpack_from(BLOCK_HEAD, b) for b in blocks]
    if not heads:
        return np.zeros(0, dtype=np.int32)
    n = sum(h[0] for h in heads)
    if [h[0] for h in heads] != block_lengths(n):
        raise ValueError("the blocks of a segment of token ids are not in order")
    lanes, longest, begin = len(heads), heads[0][0], struct.calcsize(BLOCK_HEAD)
    counts = np.array([h[2] for h in heads], dtype=np.int64)
    at = np.cumsum(counts) - counts
    literals = np.frombuffer(b"".join([b[begin + 4 * h[1] :] for b, h in zip(blocks, heads, strict=True)]) + bytes(width), dtype=f"<u{width}")
    coder = RangeDecoder([b[begin : begin + 4 * h[1]] for b, h in zip(blocks, heads, strict=True)])
    model, missed = Predictor(lanes), np.zeros((3, lanes), dtype=bool)
    now, plain, choices = np.zeros(lanes, dtype=np.int32), np.zeros(lanes, dtype=literals.dtype), model.ids.reshape(-1)
    steps = np.zeros((longest, lanes + 16), dtype=np.int32)[:, :lanes]
    for step in range(longest):
        coder.peek(model.predict(), missed)
        model.pick(missed)
        literals.take(at, out=plain, mode="clip")
        np.copyto(model.ids[3], plain, casting="unsafe")
        np.add(at, missed[2], out=at)
        choices.take(model.at, out=now, mode="clip")
        steps[step] = now
        coder.take(model.begin, model.size)
        if step & 1:
            coder.settle()
        model.compare(now)
        model.update(now, missed)
    flat = np.ascontiguousarray(steps.T).reshape(-1)[:n]
    first, little = 0, memoryview(np.ascontiguousarray(flat, dtype="<i4")).cast("B")
    for length, _, _, crc in heads:
        if zlib.crc32(little[4 * first : 4 * (first + length)]) != crc:
            raise ValueError("a block of token ids does not match its checksum")
        first += length
    return flat


def encode_segment(doc_lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, the documents' lengths, the blocks."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < MOST_ID:
        raise ValueError("a token id is out of range")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    blocks = encode_blocks(ids, width)
    head = struct.pack(HEAD, MAGIC, len(doc_lengths), len(blocks), len(ids), width)
    return b"".join([head, doc_lengths.astype("<u8").tobytes(), *blocks])


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length of each document, ids)."""
    if len(data) < struct.calcsize(HEAD) or data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    _, docs, count, n, width = struct.unpack_from(HEAD, data)
    at = struct.calcsize(HEAD) + 8 * docs
    if width not in (2, 4) or at > len(data):
        raise ValueError("a segment of token ids is incomplete")
    lengths = np.frombuffer(data, dtype="<u8", count=docs, offset=struct.calcsize(HEAD)).astype(np.int64)
    blocks = []
    for _ in range(count):
        size = struct.calcsize(BLOCK_HEAD)
        if at + size <= len(data):
            _, words, literals, _ = struct.unpack_from(BLOCK_HEAD, data, at)
            size += 4 * words + width * literals
        if at + size > len(data):
            raise ValueError("a segment of token ids is incomplete")
        blocks.append(data[at : at + size])
        at += size
    ids = decode_blocks(blocks, width)
    if len(ids) != n or lengths.sum() != n:
        raise ValueError("a segment of token ids is incomplete")
    return lengths, ids


class TextEncoder(PieceEncoder):
    """Encodes whole texts, many at a time; pieces seen before are looked up.

    For a byte-level tokenizer with the usual pattern (``widths``) texts are also cut before line breaks
    that follow something else; a word and the marks of CLOSING that end its piece are matches of
    their own; and pieces side by side are encoded as one text, whose ids are cut where the bytes of
    the pieces end. ``after`` holds ids by what follows a blank, or by line breaks and what follows them.
    """

    def __init__(self, encode_texts: Callable[[list[str]], list[np.ndarray]], widths: np.ndarray | None):
        super().__init__(lambda pieces: [ids.tobytes() for ids in encode_texts(pieces)], PIECES)
        self.encode_texts, self.widths = encode_texts, widths  # bytes of each id's token; None: not usual
        self.marks: dict[str, bytes] = {}

    def encode_joined(self, pieces: list[str]) -> list[bytes]:
        if self.widths is None:
            return self.encode_pieces(pieces)
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        out: list[bytes] = []
        for group, ids in zip(groups, self.encode_texts(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum(self.widths[ids])
            bounds = np.cumsum([len(p.encode()) for p in group] if not "".join(group).isascii() else list(map(len, group)))
            places = np.searchsorted(ends, bounds)
            if len(ends) == places[-1] + 1 and (ends[places] == bounds).all():
                data, at = ids.tobytes(), [0, *(4 * (places + 1)).tolist()]
                out += [data[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
            else:
                out += self.encode_pieces(group)
        return out

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of pieces not met before, by the same names as in ``after``."""
        whole, closed = {}, []
        for piece in pieces:
            word = piece.rstrip(CLOSING) if self.widths is not None else piece
            # Letters that every version of Unicode takes for letters.
            if len(word) < len(piece) and word[-1:].isalpha() and word[-1] < "\u0250":
                closed.append((piece, word, piece[len(word) :]))
                if word not in self.after:
                    whole[word] = None
            else:
                whole[piece] = None
        names = list(whole)
        made = dict(zip(names, self.encode_joined([p if p[0] == "\n" else " " + p for p in names]), strict=True))
        if len(self.marks) > 10_000:
            self.marks.clear()
        if unmet := list({marks for _, _, marks in closed} - self.marks.keys()):
            self.marks.update(zip(unmet, self.encode_pieces(unmet), strict=True))
        for piece, word, marks in closed:
            ids = made[word] if word in whole else self.after[word]
            made[piece] = ids + self.marks[marks]
        return made

    def encode_group(self, texts: list[str]) -> list[bytes]:
        rows, met = [], set()
        for text in texts:
            if self.widths is not None and "\n" in text:
                text = text.replace("\n", " \n").replace("\n \n", "\n\n")
            first, *rest = text.split(" ")
            rows.append((first, rest))
            met.update(rest)
        # Few enough pieces to stay in the processor's cache, unlike all that are kept.
        pieces = list(met)
        here = dict(zip(pieces, map(self.after.get, pieces), strict=True))
        new = [p for p, ids in here.items() if ids is None]
        # A piece that may be cut off is not empty and has no white space at its ends, but for a line break before it.
        odd = {p for p in new if not p or p[-1].isspace() or (p[0].isspace() and (p[0] != "\n" or self.widths is None))}
        made = self.learn([p for p in new if p not in odd] if odd else new)
        if len(self.after) + len(made) > self.most:
            # The commonest pieces are among those at hand.
            self.after.clear()
            if len(here) < self.most // 2:
                self.after.update((p, ids) for p, ids in here.items() if ids is not None)
        here.update(made)
        self.after.update((p, ids) for p, ids in made.items() if len(p) <= 64)
        heads = list({first for first, _ in rows})
        head_ids = dict(zip(heads, self.encode_pieces(heads), strict=True))
        out = []
        for text, (first, rest) in zip(texts, rows, strict=True):
            if first[-1:].isspace() or (odd and not odd.isdisjoint(rest)):
                out.append(self.encode_odd(text))
            else:
                out.append(head_ids[first] + b"".join(map(here.__getitem__, rest)))
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TEXTS:
                yield from self.encode_group(group)
                group, size = [], 0
        yield from self.encode_group(group)

    def encode(self, text: str) -> bytes:
        return self.encode_group([text])[0]

    def encode_odd(self, text: str) -> bytes:
        """Cut at blanks alone, or before runs of white space."""
        # ``after`` would take a line break after a blank for one without.
        return b"".join(self.encode_pieces(cuts(text))) if " \n" in text else super().encode(text)


def byte_widths(tokenizer: dict, vocabulary: dict[str, int]) -> np.ndarray | None:
    """Bytes of each id's token, if the tokenizer is byte-level with the usual pattern and nothing else."""
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    before = tokenizer.get("pre_tokenizer") or {}
    added = tokenizer.get("added_tokens") or []
    if tokenizer.get("normalizer") or any(before.get(k) != v for k, v in usual.items()):
        return None
    if any(t["lstrip"] or t["rstrip"] or any(c.isspace() or c in CLOSING for c in t["content"]) for t in added):
        return None
    widths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for token, i in vocabulary.items():
        widths[i] = len(token)
    for token in added:
        widths[token["id"]] = len(token["content"].encode())
    return widths


def library_encoder(data: bytes) -> TextEncoder:
    """The tokenizers library behind the look-up of pieces; an added token holds no blank, so cuts at blanks leave it whole."""
    kept = worker_cache("tokenizers")
    key = zlib.crc32(data)
    if key not in kept:
        # Spark gives a task one core: threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode())
        kept[key] = TextEncoder(
            lambda texts: [np.array(e.ids, dtype="<i4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)],
            byte_widths(json.loads(data), tokenizer.get_vocab()),
        )
    return kept[key]


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, path: str) -> None:
    """Write the ids of all texts in ascending order of doc_id, null ids first.

    Every row of the files is a segment of whole documents: ``part`` and ``segment`` give its
    place, ``doc_ids`` its documents, ``data`` the coded ids. Texts are range-partitioned by id,
    and each task codes its range; null texts have the end id alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_file(tokenizer_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(shared.value), np.array([end_id], dtype="<i4").tobytes()
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, texts, size = [], [], 0

        def close():
            lengths = np.array([len(t) // 4 for t in texts], dtype=np.int64)
            data = encode_segment(lengths, np.frombuffer(b"".join(texts), dtype="<i4"))
            names = ["part", "segment", "start", "n_ids", "doc_ids", "data"]
            values = [[part], [segment], [start], [int(lengths.sum())], [doc_ids], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in slices(batches, 256):
            coded_texts = encoder.encode_all(t or "" for t in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded_texts, strict=True):
                doc_ids.append(doc_id)
                texts.append(ids + end)
                size += len(texts[-1]) // 4
                if size >= SEGMENT:
                    yield close()
                    segment, start = segment + 1, start + size
                    doc_ids, texts, size = [], [], 0
        if texts:
            yield close()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = plain.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    coded = ranged.mapInArrow(run, "part int, segment int, start long, n_ids long, doc_ids array<long>, data binary")
    coded.write.parquet(path)


def id_lists(ids: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))]


def digests(ids: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    little, ends = memoryview(np.ascontiguousarray(ids, dtype="<i4")).cast("B"), 4 * np.cumsum(lengths)
    crc = [zlib.crc32(little[a:b]) for a, b in zip((ends - 4 * lengths).tolist(), ends.tolist(), strict=True)]
    return [pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]


def read_token_files(spark, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids) of every document, with the number of ids before it in all files.

    With ``digest`` the ids stay where they are decoded, and their ``n_tokens`` and ``ids_crc32`` come instead.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per part: the only sort in a single task.
    shift = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    shifts = settled(spark, totals.select("part", shift.alias("shift")))
    made, names = (digests, ["n_tokens", "ids_crc32"]) if digest else (id_lists, ["ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):  # a segment is some MB
            for row in batch.to_pylist():
                lengths, ids = decode_segment(row["data"])
                ends = np.cumsum(lengths)
                starts = row["start"] + row["shift"] + ends - lengths
                for low in range(0, len(lengths), 512):
                    high = min(len(lengths), low + 512)
                    own = ids[int(ends[low] - lengths[low]) : int(ends[high - 1])]
                    columns = [pa.array(row["doc_ids"][low:high], pa.int64()), pa.array(starts[low:high]), *made(own, lengths[low:high])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", *names])

    placed = rows.join(shifts, "part").select("start", "shift", "doc_ids", "data")
    return placed.mapInArrow(run, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>"))


def with_crc(df: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            columns = [batch.column(0), batch.column(1), *digests(flat[ends[0] : ends[-1]], np.diff(ends).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_tokens(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), public_file("byte_bpe_50k.json"), 2, path)
    return read_token_files(spark, path, digest=True)
