"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents, fit_in_task, fold, fresh, labelled_sample, worker_cache
from gaugework.session import scope

BUCKETS = 1 << 18
FACTORS = 8
PER_CLASS = 4000
CACHE = 400_000
THRESHOLD = 0.7
TELLING = 12.0  # chi-square of a term and the label in the sample, from which the proximal step is light
LIGHT, FIRM = (5e-5, 1e-3), (3e-2, 2e-2)  # strength of the proximal step on weights and on factors
LEAST = 3  # sampled texts in which a term must occur to have a weight


def terms_of(word: str) -> tuple[int, int, int]:
    """Hash buckets of a word and of its beginnings of four and five letters."""
    parts = (word, word[:4] + "*", word[:5] + "*")
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


def words_of(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


def terms_in(text: str, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    found: set[int] = set()
    for word in words_of(text):
        if word not in known:
            known[word] = terms_of(word)
        found.update(known[word])
    return np.fromiter(found, dtype=np.int64, count=len(found))


def segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; an empty segment sums to 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def logits(terms: np.ndarray, ends: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output per document, and the sums of its factors."""
    v = model["v"][terms]
    sums = segments(v, ends)
    pairs = 0.5 * (np.square(sums) - segments(np.square(v), ends)).sum(axis=1)
    return model["w0"] + segments(model["w"][terms], ends) + pairs, sums


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which buckets go with one label or the other beyond chance (classes counted alike)."""
    one = np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == 1]), minlength=BUCKETS)
    all_ = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    n, n1 = len(rows), (y == 1).sum()
    expected = all_ * (n1 / n)
    rest = np.maximum(expected * (1 - n1 / n) * (1 - all_ / n), 1e-9)
    return (np.square(np.abs(one - expected) - 0.5) / rest >= TELLING) & (all_ >= LEAST)


def fit_machine(texts: list[str], labels: list[int], share: float, epochs: int = 40, batch: int = 64, seed: int = 11) -> dict:
    """AdaGrad with a proximal step, over all terms of at least LEAST texts.

    No term is screened by itself: one that tells something only beside another is kept by its
    factors. Those that tell nothing alone are held by a firmer proximal step.

    The classes count alike while fitting; the constant then takes up their real odds.
    Without both labels the model is a constant.
    """
    model = {"w0": np.zeros(1), "w": np.zeros(BUCKETS), "v": np.zeros((BUCKETS, FACTORS))}
    y = np.asarray(labels, dtype=float)
    if len(set(labels)) < 2:
        model["w0"][:] = 0.0 if not labels else (20.0 if labels[0] == 1 else -20.0)
        return model
    known: dict[str, tuple[int, ...]] = {}
    rows = [terms_in(t, known) for t in texts]
    rng = np.random.default_rng(seed)
    live = np.bincount(np.concatenate(rows), minlength=BUCKETS) >= LEAST
    rows = [r[live[r]] for r in rows]
    light = telling(rows, y)
    hold_w, hold_v = (np.where(light, a, b) for a, b in zip(LIGHT, FIRM, strict=True))
    used = np.flatnonzero(live)
    model["v"][used] = rng.normal(0, 0.02, (len(used), FACTORS))
    gw, gv, g0 = np.full(BUCKETS, 1e-2), np.full((BUCKETS, FACTORS), 1e-2), 1e-2
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for epoch in range(epochs):
        rate = 1.0 / (1 + 0.1 * epoch)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            lengths = np.array([len(rows[i]) for i in pick])
            terms, ends = np.concatenate([rows[i] for i in pick]), np.cumsum(lengths)
            z, sums = logits(terms, ends, model)
            slope = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            g0 += slope.sum() ** 2
            model["w0"] -= rate * slope.sum() / np.sqrt(g0)
            if not len(terms):
                continue
            each = np.repeat(slope, lengths)
            unique, where = np.unique(terms, return_inverse=True)
            dw = np.bincount(where, weights=each, minlength=len(unique))
            v = model["v"][unique]
            per = np.repeat(slope[:, None] * sums, lengths, axis=0)
            dv = np.stack([np.bincount(where, weights=per[:, f], minlength=len(unique)) for f in range(FACTORS)], axis=1)
            dv -= dw[:, None] * v
            gw[unique] += dw**2
            gv[unique] += dv**2
            step = rate / np.sqrt(gw[unique])
            w = model["w"][unique] - step * dw
            model["w"][unique] = np.sign(w) * np.maximum(0, np.abs(w) - step * hold_w[unique])
            v = v - rate / np.sqrt(gv[unique]) * dv * 0.3
            size = np.sqrt((v**2).sum(axis=1, keepdims=True))
            model["v"][unique] = v * np.maximum(0, 1 - rate * hold_v[unique][:, None] / np.maximum(size, 1e-12))
    share = min(max(share, 1e-6), 1 - 1e-6)
    model["w0"] += np.log(share / (1 - share))
    return model


def pack(model: dict[str, np.ndarray]) -> bytes:
    """Only the terms with a weight are kept."""
    live = np.flatnonzero((model["w"] != 0) | (model["v"] != 0).any(axis=1))
    out = io.BytesIO()
    np.savez(out, w0=model["w0"], live=live, w=model["w"][live], v=model["v"][live])
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def score_texts(texts: list[str | None], model: dict[str, np.ndarray], known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Probabilities of label 1. ``known`` keeps the live terms of words seen before."""
    place = {int(b): i for i, b in enumerate(model["live"])}
    found, lengths = [], []
    for text in texts:
        words = words_of(text or "")
        for word in words:
            if word not in known:
                known[word] = tuple(place[b] for b in terms_of(word) if b in place)
        live = set(chain.from_iterable(map(known.__getitem__, words)))
        found.extend(sorted(live))
        lengths.append(len(live))
        if len(known) > CACHE:
            known.clear()
    if not lengths:
        return np.zeros(0)
    z, _ = logits(np.asarray(found, dtype=np.int64), np.cumsum(lengths), model)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS) -> bytes:
    """Fit on a bounded sample: ``per_class`` whole texts of each label, of SAMPLE_BYTES together."""
    with scope(docs.sparkSession):
        sample, share = labelled_sample(docs, labels, "toxic", train, per_class)
        return fit_in_task(sample, lambda texts, y: pack(fit_machine(texts, y, share)))


def toxicity_score(docs: DataFrame, packed: bytes, name: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = unpack(shared.value)
        known = worker_cache(f"toxicity-{zlib.crc32(shared.value)}")
        for batch in batches:
            yield pa.array(score_texts(batch.to_pylist(), model, known), pa.float64())

    return docs.withColumn(name, score(F.col("text")))


def op4_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(spark, sf_dir)
    packed = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1)
    scored = toxicity_score(docs.select("doc_id", "text"), packed)
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    packed = train_toxicity(docs, labels, fold("doc_id", 3) != 1)
    name = fresh(docs, "toxicity")
    return toxicity_score(docs, packed, name).where(F.col(name) < threshold).select(*docs.columns)
