"""Bounded states of the transducer, and rounds of the language model that shuffle by tasks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gaugework.llm import bpe, lm


def test_rare_states_pass_by(monkeypatch):
    """However many states the texts need, no more than the bound are kept, and the ids are those of plain merging."""
    rng = random.Random(5)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 400:
        a, b = rng.choices([t for t in ranks if len(t) < 6 and set(t) <= set(b"abcd")], k=2)
        if a + b not in ranks and bpe.Transducer(ranks).merged(a + b, len(ranks)) == [a, b]:
            ranks[a + b] = len(ranks)
    monkeypatch.setattr(bpe, "STATES", 40)
    monkeypatch.setattr(bpe, "PASSING", 2_000)
    transducer, restarts = bpe.Transducer(ranks), []
    restart = transducer.restart
    transducer.restart = lambda: (restarts.append(1), restart())
    for _ in range(300):
        word = bytes(rng.choices(b"abcd", k=rng.randint(1, 60)))
        wanted = [ranks[part] for part in transducer.merged(word, len(ranks))]
        assert transducer.encode(word) == wanted and len(transducer.states) <= 40
    assert restarts


def test_copies_are_added_up_in_their_tasks(spark, monkeypatch):
    """Many copies, but no more parts in a round's shuffle than cores; every row has its scores."""
    frame, dealt = type(spark.range(1)), []
    real = frame.repartitionById
    monkeypatch.setattr(frame, "repartitionById", lambda df, n, *columns: (dealt.append(n), real(df, n, *columns))[1])
    monkeypatch.setattr(lm, "COPY_TOKENS", 32)
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.hash("id", F.lit(i)), F.lit(20))) for i in range(8)])
    docs = spark.range(200).select(F.col("id").alias("doc_id"), words.alias("text"))
    out = lm.lm_scores(docs, F.col("doc_id") % 7 != 2).collect()
    assert len(out) == 200 and all(r["score"] < 0 for r in out) and out[0]["train_tokens"] > 40 * 32
    assert len(dealt) == lm.ROUNDS and max(dealt) <= spark.sparkContext.defaultParallelism
