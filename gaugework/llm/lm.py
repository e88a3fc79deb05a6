"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents, fold, slices, text_bytes
from gaugework.session import cut_lineage, scratch_path

TYPES = 1022  # so many of the commonest words have vectors of their own at any count,
LEAST = 100  # and every word that occurs that often in the training texts
KNOWN = 1 << 16  # at least so many words' counts are broadcast; the others' are joined
HEAD = 256  # ids predicted by themselves; the others by their class, then within it
WIDTH = 32
NOISE = 48  # noise words, shared by a batch
NOISE_INSIDE = 5  # noise words from the class of each word that has one
BATCH = 4096
COPY_TOKENS, COPIES = 1 << 22, 4096  # training tokens per copy of the model, and the most copies
ROUNDS = 4  # how often the copies are averaged
WHOLE = float(1 << 20)  # averages are sums of whole numbers of this fineness
FLUSH = 1 << 22
ALONE = 32  # with so few rows left, each row's values are summed by itself
TEXTS = 1024  # texts scored at once; the more, the more contexts they share
POWERS = 3 << 22  # numbers in either table of the commonest words' powers of e
SCORED = 1 << 16  # scores worked on at once
SAFE = 70.0  # scores up to here, and sums of their powers of e, are in the range of a float
OTHER, END = 0, 1
END_HASH = int(np.uint64(xxhash.xxh3_64_intdigest(b"")).view(np.int64))  # no word is empty


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the text's words, and of the end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out = out.view(np.int64)
    out[-1] = END_HASH
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word occurs in the texts, by hash; the end counts once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                held.append(word_hashes(text))
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    partial = docs.select("text").mapInArrow(run, "h long, c long")
    return partial.groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The commonest words: their hashes in order, counts, and model ids."""

    def __init__(self, common: np.ndarray | list[tuple[int, int]], total: int, distinct: int):
        """``common`` holds (hash, count), the commonest first."""
        common = np.asarray(common, dtype=np.int64).reshape(-1, 2)
        words = common[common[:, 0] != END_HASH]
        types = words[(np.arange(len(words)) < TYPES) | (words[:, 1] >= LEAST)]
        self.size = len(types) + 2
        number = np.append(np.arange(2, self.size), END)
        with_id = np.append(types[:, 0], END_HASH)
        order = np.argsort(common[:, 0])
        self.hashes, self.counts = common[order, 0], common[order, 1]
        by_hash = np.argsort(with_id)
        at = np.minimum(np.searchsorted(with_id[by_hash], self.hashes), len(with_id) - 1)
        self.ids = np.where(with_id[by_hash][at] == self.hashes, number[by_hash][at], OTHER)
        self.shift = max(32, 62 - len(common).bit_length())
        buckets = np.arange(-(1 << (63 - self.shift)), 1 << (63 - self.shift), dtype=np.int64)
        self.begin = np.searchsorted(self.hashes >> self.shift, buckets).astype(np.int32)  # by a hash's first bits
        self.fence = np.append(self.hashes, np.iinfo(np.int64).max)
        self.total, self.distinct = total, distinct
        own = np.zeros(self.size, dtype=np.int64)
        inside = self.ids != OTHER
        own[self.ids[inside]] = self.counts[inside]
        self.other_total, self.other_distinct = total - int(own.sum()), distinct - int(inside.sum())
        own[OTHER] = self.other_total
        self.own = own

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model id and count of each hash; the count is -1 where it is not among the known ones."""
        if not len(self.hashes):
            return np.where(h == END_HASH, END, OTHER), np.full(len(h), -1, dtype=np.int64)
        at = self.begin[(h >> self.shift) + (1 << (63 - self.shift))]
        left = np.flatnonzero(self.fence[at] < h)
        while len(left):
            at[left] += 1
            left = left[self.fence[at[left]] < h[left]]
        at = np.minimum(at, len(self.hashes) - 1)
        hit = self.hashes[at] == h
        ids = np.where(hit, self.ids[at], np.where(h == END_HASH, END, OTHER))
        return ids, np.where(hit, self.counts[at], -1)


def class_size(size: int) -> int:
    """Ids of a class: about as many as there are classes, so that both sums stay short."""
    return max(1, math.isqrt(max(0, size - HEAD)))


def outputs_of(ids: np.ndarray, size: int) -> np.ndarray:
    """What is predicted first: the id itself, or the class of a rarer one."""
    return np.where(ids < HEAD, ids, HEAD + (ids - HEAD) // class_size(size))


def output_shares(own: np.ndarray) -> np.ndarray:
    share = np.bincount(outputs_of(np.arange(len(own)), len(own)), weights=own + 1.0)
    return share / share.sum()


def first_model(size: int, own: np.ndarray, seed: int = 13) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    share = output_shares(own)
    small = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
    of_class = share[outputs_of(np.arange(HEAD, size), size)] * (own + 1.0).sum()
    inside = np.log((own[HEAD:] + 1.0) / of_class).astype(np.float32)
    return {
        "r": small(size + 1),  # what a word says as context; the last one stands before the text
        "q": small(len(share)),  # what a word or class is as target
        "c": np.full((2, WIDTH), 0.5, np.float32),  # weight of the last and the last but one
        "b": np.log(share).astype(np.float32),
        "t": np.column_stack([small(max(0, size - HEAD)), inside]),  # what a word is inside its class, and its bias
    }


def contexts(ids: np.ndarray, before: int, starts: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one id at each position of texts that begin at ``starts``."""
    one, two = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for out, back in ((one, ids), (two, one)):
        out[1:] = back[:-1]
        out[starts] = before
    return one, two


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sum of the values of each."""
    bits = len(rows).bit_length()
    kind = np.uint32 if int(rows.max()) >> (32 - bits) == 0 else np.int64  # shorter numbers are sorted faster
    keys = np.sort(rows.astype(kind) << kind(bits) | np.arange(len(rows), dtype=kind))
    ordered, order = (keys >> kind(bits)).astype(np.int64), (keys & kind((1 << bits) - 1)).astype(np.int64)
    bounds = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    starts, counts = bounds[:-1], np.diff(bounds)
    sums, taken = values.take(order[starts], axis=0), 1
    left = np.flatnonzero(counts > 1)
    while len(left) > ALONE:
        sums[left] += values.take(order[starts[left] + taken], axis=0)
        taken += 1
        left = left[counts[left] > taken]
    for i in left.tolist():
        sums[i] += np.add.reduce(values.take(order[starts[i] + taken : bounds[i + 1]], axis=0), axis=0)
    return ordered[starts], sums


def adjust(values: np.ndarray, squares: np.ndarray, steps: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
    """An AdaGrad step on some rows, with one rate a row; ``rows`` may repeat."""
    at, g = summed(rows, grads)
    g *= np.float32(30)
    square = squares[at] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
    squares[at] = square
    g *= (np.float32(0.12) / np.sqrt(square))[:, None]
    # As one item a row, which NumPy copies faster than numbers.
    item = np.dtype((np.void, values.itemsize * values.shape[1]))
    values.view(item)[at, 0] = (values.take(at, axis=0) - g).view(item)[:, 0]
    steps[at] += 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Changes ``x``, which saves time, and returns it."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def first_pace(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """AdaGrad's sums before the first step: one a row for the words' vectors."""
    pace = {k: np.full_like(model[k], 1e-2) for k in ("q", "b", "c")}
    return pace | {k: np.full(len(model[k]), 1e-4, np.float32) for k in ("r", "t")}


def pace_rows(pace: dict[str, np.ndarray]) -> np.ndarray:
    """Square roots of the sums beside the rows of ``as_rows``: of the row, averaged, and of an output's bias."""
    mean = {k: pace[k].mean(axis=1) for k in "qc"}
    rows = np.concatenate([pace["r"], mean["q"], mean["c"], pace["t"]])
    bias = np.zeros_like(rows)
    bias[len(pace["r"]) : len(pace["r"]) + len(pace["b"])] = pace["b"]
    return np.sqrt(np.column_stack([rows, bias]))


def pace_from_rows(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    r, q, c, t = np.split(np.square(rows), np.cumsum([len(like[k]) for k in "rqc"]))
    wide = lambda x: np.repeat(x[:, :1], WIDTH, axis=1)
    return {"r": r[:, 0].copy(), "q": wide(q), "b": q[:, 1].copy(), "c": wide(c), "t": t[:, 0].copy()}


def train_nce(
    batches: Iterator[tuple], model: dict[str, np.ndarray], own: np.ndarray, seed: int | list[int], squares: dict[str, np.ndarray] | None = None
) -> tuple[int, dict[str, np.ndarray]]:
    """AdaGrad steps on batches of (target, last, last but one), which change ``model`` and ``squares``.

    Returns the batches seen, and how often each row of the words' vectors was changed. A word
    with a class is told from noise twice: its class from all outputs, itself from its class.
    """
    rng = np.random.default_rng(seed)
    share = output_shares(own)
    cumulated, log_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
    squares = first_pace(model) if squares is None else squares
    steps = {k: np.zeros(len(model[k]), np.int64) for k in ("r", "t")}
    size, each, seen = len(own), class_size(len(own)), 0
    for w, one, two in batches:
        n = len(w)
        seen += 1
        first = outputs_of(w, size)
        noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), len(share) - 1)
        r1, r2 = model["r"].take(one, axis=0), model["r"].take(two, axis=0)
        meant = r1 * model["c"][0] + r2 * model["c"][1]
        meant_q, noise_q = model["q"].take(first, axis=0), model["q"][noise]
        true = np.einsum("ij,ij->i", meant, meant_q) + (model["b"] - log_noise)[first]
        false = meant @ noise_q.T
        false += (model["b"] - log_noise)[noise]
        # Slopes of -log sigmoid(true) - sum of log sigmoid(-false), averaged over the batch.
        g_true, g_false = sigmoid(-true), sigmoid(false)
        g_true /= -n
        g_false /= n
        grads = {k: np.zeros_like(model[k]) for k in squares if k not in steps}
        at, sums = summed(first, g_true[:, None] * meant)
        grads["q"][at] = sums
        np.add.at(grads["q"], noise, g_false.T @ meant)
        grads["b"] += np.bincount(first, weights=g_true, minlength=len(share)).astype(np.float32)
        np.add.at(grads["b"], noise, g_false.sum(axis=0))
        back = np.multiply(meant_q, g_true[:, None], out=meant_q)
        back += g_false @ noise_q
        deep = np.flatnonzero(w >= HEAD)
        if len(deep):
            place = w[deep] - HEAD
            begin = place - place % each
            length = np.minimum(each, size - HEAD - begin)
            wrong = begin[:, None] + (rng.random((len(deep), NOISE_INSIDE)) * length[:, None]).astype(np.int64)
            rows = np.column_stack([place, wrong])
            said = np.column_stack([meant[deep], np.ones(len(deep), np.float32)])
            vectors = model["t"].take(rows, axis=0)
            g = sigmoid(np.einsum("nkw,nw->nk", vectors, said) - np.log(NOISE_INSIDE / length).astype(np.float32)[:, None])
            g[:, 0] -= 1
            g /= n
            back[deep] += np.einsum("nk,nkw->nw", g, vectors)[:, :WIDTH]
            adjust(model["t"], squares["t"], steps["t"], rows.ravel(), np.multiply(g[:, :, None], said[:, None], out=vectors).reshape(-1, WIDTH + 1))
        grads["c"][0], grads["c"][1] = np.einsum("ij,ij->j", back, r1), np.einsum("ij,ij->j", back, r2)
        # A word mostly comes twice, as the last one and at the next position as the last but one.
        again = two[1:] == one[:-1]
        both, late = back * model["c"][0], back * model["c"][1]
        both[:-1] += late[1:] * again[:, None]
        apart = np.flatnonzero(np.append(True, ~again))
        adjust(model["r"], squares["r"], steps["r"], np.append(one, two[apart]), np.concatenate([both, late[apart]]))
        for k, g in grads.items():
            squares[k] += np.square(g * 30)
            model[k] -= np.float32(0.12) * (g * 30) / np.sqrt(squares[k])
    return seen, steps


def log_probabilities(ids: np.ndarray, one: np.ndarray, two: np.ndarray, model: dict[str, np.ndarray], powers: Powers | None = None) -> np.ndarray:
    """Natural log probabilities of the ids, normalised over all ids, by products over distinct contexts.

    That of an id with a class is its class's, times its own among the ids of the class.
    """
    powers = Powers(model) if powers is None else powers
    before, size = len(model["r"]), len(model["r"]) - 1
    first = outputs_of(ids, size)
    codes, where = np.unique(one * before + two, return_inverse=True)
    one, two = np.divmod(codes, before)
    meant = np.ones((len(codes), WIDTH + 1), np.float32)  # the last column takes the bias
    for some in few_rows(len(codes), WIDTH):
        meant[some, :WIDTH] = model["r"].take(one[some], axis=0) * model["c"][0] + model["r"].take(two[some], axis=0) * model["c"][1]
    longest, work = length(meant[:, :WIDTH]), np.empty(SCORED, np.float32)
    norm, outputs = powers.norms(one, two, meant, work), powers.outputs
    out = np.empty(len(ids))
    for part in few_rows(len(ids), WIDTH):
        out[part] = np.einsum("ij,ij->i", meant.take(where[part], axis=0), outputs.take(first[part], axis=0)) - norm[where[part]]
    deep = np.flatnonzero(ids >= HEAD)
    kind = np.uint16 if len(outputs) <= 1 << 16 else np.int64
    deep = deep[np.argsort(first[deep].astype(kind), kind="stable")]
    each = class_size(size)
    starts = np.flatnonzero(np.diff(first[deep], prepend=-1))
    for low, high in zip(starts, np.append(starts[1:], len(deep))[: len(starts)], strict=True):
        number = int(first[deep[low]]) - HEAD
        begin = number * each
        inside = model["t"][begin : begin + each]
        plain = longest * powers.inside[number][0] + powers.inside[number][1] < SAFE
        for some in few_rows(high - low, len(inside)):
            rows = deep[low:high][some]
            scores = products(meant.take(where[rows], axis=0), inside.T, work)
            own = scores[np.arange(len(rows)), ids[rows] - HEAD - begin].astype(np.float64)
            out[rows] += own - log_sums(scores, plain)
    return out


class Powers:
    """Powers of e of the scores of the commonest words, alone as last and as last but one.

    A score is the sum of two words' parts, and its power of e the product of theirs. So a context of two of these words
    takes a product of two rows of powers instead of new powers.
    """

    def __init__(self, model: dict[str, np.ndarray]):
        self.outputs = np.column_stack([model["q"], model["b"]])
        self.across = np.ascontiguousarray(self.outputs.T)
        self.words = min(len(model["r"]), POWERS // len(self.outputs))
        each = class_size(len(model["r"]) - 1)
        self.inside = [bounds_of(model["t"][low : low + each]) for low in range(0, len(model["t"]), each)]
        parts = [model["r"][: self.words] * c for c in model["c"]]
        if reach(length(parts[0]) + length(parts[1]), self.outputs) >= SAFE:
            self.words = 0
        self.rows = [np.empty((self.words, len(self.outputs)), np.float32) for _ in parts]
        for i, (part, made) in enumerate(zip(parts, self.rows, strict=True)):
            for some in few_rows(self.words, len(self.outputs)):
                np.matmul(part[some], self.across[:WIDTH], out=made[some])
                if i == 0:
                    made[some] += self.across[WIDTH]
                np.exp(made[some], out=made[some])

    def norms(self, one: np.ndarray, two: np.ndarray, meant: np.ndarray, work: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of the powers of all outputs for each context."""
        out, plain = np.empty(len(one)), reach(length(meant[:, :WIDTH]), self.outputs) < SAFE
        known = (one < self.words) & (two < self.words)
        rest, known = np.flatnonzero(~known), np.flatnonzero(known)
        for some in few_rows(len(rest), len(self.outputs)):
            rows = rest[some]
            out[rows] = log_sums(products(meant.take(rows, axis=0), self.across, work), plain)
        for some in few_rows(len(known), len(self.outputs)):
            rows = known[some]
            sums = np.einsum("ij,ij->i", self.rows[0].take(one[rows], axis=0), self.rows[1].take(two[rows], axis=0))
            out[rows] = np.log(sums.astype(np.float64))
        return out


def length(rows: np.ndarray) -> float:
    """That of the longest row."""
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def reach(longest: float, rows: np.ndarray) -> float:
    """No score of such a context with these rows and their biases is farther from zero."""
    vector, bias = bounds_of(rows)
    return longest * vector + bias


def bounds_of(rows: np.ndarray) -> tuple[float, float]:
    """The longest vector and the largest bias, without its sign."""
    return length(rows[:, :WIDTH]), float(np.abs(rows[:, WIDTH]).max())


def few_rows(rows: int, columns: int) -> Iterator[slice]:
    """Slices of the rows whose scores stay in a core's cache."""
    step = max(1, min(4096, SCORED // columns))
    return (slice(low, min(rows, low + step)) for low in range(0, rows, step))


def products(left: np.ndarray, across: np.ndarray, work: np.ndarray) -> np.ndarray:
    """Their matrix product; in ``work``, if it holds that many numbers."""
    shape = (len(left), across.shape[1])
    out = work[: shape[0] * shape[1]].reshape(shape) if shape[0] * shape[1] <= len(work) else None
    return np.matmul(left, across, out=out)


def log_sums(scores: np.ndarray, plain: bool) -> np.ndarray:
    """The logarithm of the sum of the powers of e of each row, which change ``scores``; ``plain``: no power is out of bounds."""
    top = np.zeros(len(scores), np.float32) if plain else scores.max(axis=1)
    if not plain:
        scores -= top[:, None]
    np.exp(scores, out=scores)
    return top + np.log((scores @ np.ones(scores.shape[1], np.float32)).astype(np.float64))


def as_rows(model: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows of one width: words as contexts, outputs, the two weights, words inside classes."""
    wide = lambda x: np.column_stack([x, np.zeros(len(x), np.float32)])
    return np.concatenate([wide(model["r"]), np.column_stack([model["q"], model["b"]]), wide(model["c"]), model["t"]])


def from_rows(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    r, q, c, t = np.split(rows, np.cumsum([len(like[k]) for k in "rqc"]))
    flat = lambda x: np.ascontiguousarray(x[:, :WIDTH])
    return {"r": flat(r), "q": flat(q), "b": q[:, WIDTH].copy(), "c": flat(c), "t": t.copy()}


def trained(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """One model from all texts of ``docs`` (doc_id, text): copies learn side by side and are averaged, ROUNDS times.

    A hash of id and text deals each text to a round and a copy, and orders it there. There is a
    copy for every COPY_TOKENS tokens, up to COPIES, so what is learned depends on the texts and not on cores or partitions.
    In each round a copy goes on from the average of the round before. Copies weigh by the batches that
    they saw, and in a word's own vectors by how often they changed them; rows that a copy never
    changed stay out. The sums are of whole numbers, whose order does not matter. What comes to the driver is one model a round.
    """
    spark = docs.sparkSession
    copies = int(max(1, min(COPIES, -(-vocabulary.total // COPY_TOKENS))))
    shared = spark.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in slices(batches):
            texts = [word_hashes(t) for t in text_bytes(batch.column(3))]
            flat, ends = vocab.look_up(np.concatenate(texts))[0].astype("<i4"), np.cumsum([0, *map(len, texts)]).tolist()
            ids = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["turn", "copy", "spot", "ids"])

    spot = F.xxhash64("doc_id", "text")
    turn, copy = F.pmod(spot, F.lit(ROUNDS)).cast("int"), F.pmod(F.shiftright(spot, 8), F.lit(copies)).cast("int")
    dealt = docs.select(turn.alias("turn"), copy.alias("copy"), spot.alias("spot"), "text")
    path, shape = scratch_path(spark, "training-ids"), "turn int, copy int, spot long, ids binary"
    dealt.mapInArrow(encode, shape).write.partitionBy("turn").parquet(path)
    model = first_model(vocabulary.size, vocabulary.own)
    pace = first_pace(model)
    for turn in range(ROUNDS):
        rows = spark.read.schema(shape).parquet(path).where(F.col("turn") == turn).select("copy", "spot", "ids")
        model, pace = one_round(rows, shared, model, pace, turn, copies)
    return model


def one_round(rows: DataFrame, shared, model: dict, pace: dict, turn: int, copies: int) -> tuple[dict, dict]:
    """The average of the copies after this round's texts (copy, spot, ids as bytes), and of their AdaGrad sums.

    A task trains its copies one after another and adds them up, in whole numbers, so what is shuffled grows with the
    cores and the vocabulary, not with the copies.
    """
    spark = rows.sparkSession
    before = spark.sparkContext.broadcast((model, pace))
    columns = [f"v{i}" for i in range(WIDTH + 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        texts = (row for batch in slices(batches) for row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        total, weight = None, 0.0
        for copy, group in groupby(texts, key=lambda row: row[0]):
            mine, squares = ({k: v.copy() for k, v in part.items()} for part in before.value)
            batches_seen, steps = train_nce(positions((np.frombuffer(ids, "<i4") for _, ids in group), vocab.size), mine, vocab.own, [19, turn, copy], squares)
            weights = np.concatenate([steps["r"], np.full(len(mine["q"]) + 2, batches_seen), steps["t"]])
            table = np.column_stack([as_rows(mine), pace_rows(squares)])
            total = np.zeros(table.shape, np.int64) if total is None else total
            for low in range(0, len(table), 1 << 15):
                part = slice(low, low + (1 << 15))
                total[part] += (table[part].astype(np.float64) * weights[part, None] * WHOLE).astype(np.int64)
            weight = weight + weights.astype(np.float64)
        changed = np.flatnonzero(weight)
        for low in range(0, len(changed), 1 << 15):
            places = changed[low : low + (1 << 15)]
            values = [pa.array(v) for v in np.ascontiguousarray(total[places].T)]
            head = [pa.array(places.astype(np.int32)), pa.array(weight[places])]
            yield pa.RecordBatch.from_arrays([*head, *values], ["place", "weight", *columns])

    tasks = min(copies, spark.sparkContext.defaultParallelism)
    own = rows.repartitionById(tasks, (F.col("copy") % tasks).cast("int")).sortWithinPartitions("copy", "spot")
    made = own.mapInArrow(run, "place int, weight double, " + ", ".join(f"{c} long" for c in columns))
    mean = [(F.sum(c) / F.sum("weight") / WHOLE).alias(c) for c in columns]
    averaged = made.repartition("place").groupBy("place").agg(*mean).toArrow()
    before.unpersist()
    table = np.column_stack([as_rows(model), pace_rows(pace)])
    places = averaged.column("place").to_numpy()
    for i, c in enumerate(columns):
        table[places, i] = averaged.column(c).to_numpy()
    return from_rows(table[:, : WIDTH + 1], model), pace_from_rows(table[:, WIDTH + 1 :], model)


def positions(texts: Iterator[np.ndarray], before: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (id, last, last but one) over all positions of the texts."""
    held, size = [], 0

    def flush():
        ids = np.concatenate(held).astype(np.int64)
        joined = (ids, *contexts(ids, before, np.cumsum([0, *map(len, held[:-1])])))
        held.clear()
        for low in range(0, len(ids), BATCH):
            yield tuple(v[low : low + BATCH] for v in joined)

    for ids in texts:
        held.append(ids)
        size += len(ids)
        if size >= BATCH:
            yield from flush()
            size = 0
    if size:
        yield from flush()


def lm_scores(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``train`` selects the rows that are learned from. Tokens are the words in lower case
    and one end per text; a null text has the end alone. ``base_score`` is the add-one
    unigram log10 probability. ``score`` is the model's: the log-bilinear model gives the
    word, or that it is any other word, normalised; another word's share among these is add-one.
    Every word that occurs LEAST times is in the model. The counts cover all training texts; those
    of the KNOWN commonest words and of the model's are broadcast, the others are joined.
    """
    learned = docs.where(train).select("doc_id", "text")
    counts = cut_lineage(token_counts(learned), "token-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"])
    often = counts.where(F.col("c") >= LEAST)
    common = (often if often.count() >= KNOWN else counts.orderBy(F.desc("c"), "h").limit(KNOWN)).select("h", "c").toArrow()
    common = np.column_stack([common.column("h").to_numpy(), common.column("c").to_numpy()])
    vocabulary = Vocabulary(common[np.lexsort((common[:, 0], -common[:, 1]))], n, v)
    model = trained(learned, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    per_other = np.log10(vocabulary.other_total + vocabulary.other_distinct + 1)
    shape = "doc_id long, n_tokens long, known long, base double, score double, h array<long>, t array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lm = shared.value
        powers = Powers(lm)
        per_token = np.log10(n + v + 1)
        for batch in slices(batches, TEXTS):
            texts = [word_hashes(t) for t in text_bytes(batch.column(1))]
            ends = np.cumsum([len(t) for t in texts])
            starts = ends - [len(t) for t in texts]
            h = np.concatenate(texts)
            ids, c = vocab.look_up(h)
            one, two = contexts(ids, vocab.size, starts)
            model_log = log_probabilities(ids, one, two, lm, powers) / np.log(10)
            seen = np.log10(np.maximum(c, 0) + 1.0)
            base, score = seen - per_token, model_log + np.where(ids == OTHER, seen - per_other, 0.0)
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has its end
            rare = [np.unique(h[a:b][c[a:b] < 0], return_counts=True) for a, b in zip(starts, ends, strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rare])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[i] for r in rare]).astype(np.int64))) for i in (0, 1)]
            columns = [batch.column(0), pa.array(ends - starts), pa.array(total((c >= 0).astype(np.int64)))]
            columns += [pa.array(total(base)), pa.array(total(score)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "known", "base", "score", "h", "t"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("h", "t")).alias("w")).select("row", "w.h", "w.t")
    found = rare.join(counts, "h").groupBy("row").agg(
        F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("t").alias("also")
    )
    out = scored.drop("h", "t").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op7_lm(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir), fold("doc_id", 7) != 2)
