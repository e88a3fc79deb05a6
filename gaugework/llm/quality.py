"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents, fit_in_task, fold, fresh, labelled_sample, text_bytes
from gaugework.session import scope

STRIDE = 8  # bytes between the beginnings of chunks; a chunk is twice as long
EMBEDDED = 8
FILTERS = 32
HIDDEN = 16
PER_CLASS = 2500
SLICE = 1 << 15  # blocks convolved at once
THRESHOLD = 0.3


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another in blocks of STRIDE bytes, each padded and closed by an empty block.

    Returns the blocks and where each text's blocks begin (and the last ones end). A chunk
    is a block with the one after it, so every byte is in two chunks but for the first ones.
    """
    counts = np.array([-(-len(t) // STRIDE) + 1 + (not t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(starts[-1]) * STRIDE, dtype=np.uint8)
    for text, at in zip(texts, starts[:-1] * STRIDE, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return flat.reshape(-1, STRIDE), starts


def pooled(blocks: np.ndarray, starts: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """The largest answer of each filter over all chunks of each text, in slices of bounded size."""
    texts = len(starts) - 1
    best = np.full((texts, FILTERS), -np.inf, dtype=np.float32)
    both = np.concatenate([model["first"], model["second"]], axis=1)
    for low in range(0, len(blocks) - 1, SLICE):
        high = min(len(blocks) - 1, low + SLICE)
        inside = model["embed"][blocks[low : high + 1]].reshape(high + 1 - low, -1) @ both
        answer = inside[:-1, :FILTERS] + inside[1:, FILTERS:]
        # Chunks of text i: blocks starts[i] to starts[i + 1] - 2.
        a = int(np.searchsorted(starts, low, side="right")) - 1
        b = int(np.searchsorted(starts, high, side="left"))
        begin = np.maximum(starts[a:b], low) - low
        end = np.minimum(starts[a + 1 : b + 1] - 1, high) - low
        some = begin < end
        if some.any():
            cuts = np.stack([begin[some], end[some]], axis=1).ravel()
            most = np.maximum.reduceat(np.concatenate([answer, answer[-1:]]), cuts, axis=0)[::2]
            rows = np.arange(a, b)[some]
            best[rows] = np.maximum(best[rows], most)
    return best


def head(best: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    features = np.maximum(best + model["bias"], 0)
    hidden = np.maximum(features @ model["dense"] + model["dense_bias"], 0)
    return features, hidden, hidden @ model["out"] + model["out_bias"]


def score_bytes(texts: list[bytes], model: dict[str, np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """Probabilities of label 1, laid out about ``most`` bytes at a time."""
    out, group, size = [], [], 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= most or i == len(texts) - 1:
            z = head(pooled(*lay_out(group), model), model)[2]
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64) + model["prior"], -40, 40))))
            group, size = [], 0
    return np.concatenate(out) if out else np.zeros(0)


def fit_network(texts: list[bytes], labels: list[int], share: float, steps_wanted: int = 1000, batch: int = 64, seed: int = 5) -> dict:
    """Adam on balanced classes; only the chunk that won the pooling gets a filter's gradient.

    The constant then takes up the real odds of the classes. Without both labels the
    model is a constant.
    """
    rng = np.random.default_rng(seed)
    width = STRIDE * EMBEDDED
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    model = {
        "embed": normal(256, EMBEDDED, scale=1.0), "first": normal(width, FILTERS, scale=0.09), "second": normal(width, FILTERS, scale=0.09),
        "bias": np.zeros(FILTERS, np.float32), "dense": normal(FILTERS, HIDDEN, scale=0.18), "dense_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, scale=0.25), "out_bias": np.zeros((), np.float32),
    }
    y = np.asarray(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        zero = {k: np.zeros_like(v) for k, v in model.items()}
        return zero | {"prior": np.float64(0.0 if not labels else (20.0 if labels[0] == 1 else -20.0))}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32) * len(y)
    steps, epochs = 0, min(150, -(-steps_wanted * batch // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            blocks, starts = lay_out([texts[i] for i in pick])
            x = model["embed"][blocks].reshape(len(blocks), -1)
            answer = x[:-1] @ model["first"] + x[1:] @ model["second"]
            won = np.stack([a + answer[a : b - 1].argmax(axis=0) for a, b in zip(starts[:-1], starts[1:], strict=True)])
            best = np.take_along_axis(answer, won, axis=0)
            features, hidden, z = head(best, model)
            slope = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            grad = {"out": hidden.T @ slope, "out_bias": slope.sum()}
            back = np.outer(slope, model["out"]) * (hidden > 0)
            grad |= {"dense": features.T @ back, "dense_bias": back.sum(axis=0)}
            back = (back @ model["dense"].T) * (features > 0)
            grad["bias"] = back.sum(axis=0)
            left, right = x[won], x[won + 1]  # (texts, filters, width)
            grad["first"] = np.einsum("tf,tfw->wf", back, left)
            grad["second"] = np.einsum("tf,tfw->wf", back, right)
            embed = np.zeros_like(model["embed"])
            for side, place in (("first", won), ("second", won + 1)):
                pulled = (back[:, :, None] * model[side].T[None]).reshape(-1, EMBEDDED)
                np.add.at(embed, blocks[place].reshape(-1), pulled)
            grad["embed"] = embed
            steps += 1
            rate = 4e-3 * min(1, steps / 30) * (1 - epoch / epochs)
            for k, g in grad.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (np.square(g) - v)
                model[k] = model[k] - np.float32(rate) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
                state[k] = (m, v)
    share = min(max(share, 1e-6), 1 - 1e-6)
    model = {k: np.asarray(v, dtype=np.float32) for k, v in model.items()}
    return model | {"prior": np.float64(np.log(share / (1 - share)))}


def pack(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpack(data: bytes) -> dict:
    return dict(np.load(io.BytesIO(data)))


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS) -> bytes:
    """Fit on a bounded sample: ``per_class`` whole texts of each label, of SAMPLE_BYTES together."""
    with scope(docs.sparkSession):
        sample, share = labelled_sample(docs, labels, "quality", train, per_class)
        return fit_in_task(sample, lambda texts, y: pack(fit_network([t.encode() for t in texts], y, share)))


def quality_score(docs: DataFrame, packed: bytes, name: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is good; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = unpack(shared.value)
        for batch in batches:
            yield pa.array(score_bytes(list(text_bytes(batch)), model), pa.float64())

    return docs.withColumn(name, score(F.col("text")))


def op2_quality(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(spark, sf_dir)
    packed = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    scored = quality_score(docs.select("doc_id", "text"), packed)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    packed = train_quality(docs, labels, fold("doc_id", 5) != 0)
    name = fresh(docs, "quality")
    return quality_score(docs, packed, name).where(F.col(name) >= threshold).select(*docs.columns)
