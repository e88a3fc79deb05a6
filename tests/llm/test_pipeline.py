"""Each stage of the pipeline on whole small tables, against plain loops over what the stage before kept."""

from __future__ import annotations

import numpy as np
import tiktoken

import corpus_pipeline
from gaugework.llm import bpe, minhash, quality, toxicity
from gaugework.llm.common import fold
from tests.llm.test_spark import plain_groups

SF = "/root/testdata/sf0.001"


def plain_toxicity(text, model):
    """The machine's probability, pair by pair."""
    place = {int(b): i for i, b in enumerate(model["live"])}
    terms = sorted({place[b] for w in toxicity.words_of(text) for b in toxicity.terms_of(w) if b in place})
    z = float(model["w0"][0]) + sum(float(model["w"][t]) for t in terms)
    for i, a in enumerate(terms):
        z += sum(float(model["v"][a] @ model["v"][b]) for b in terms[:i])
    return 1 / (1 + np.exp(-z))


def plain_quality(data, model):
    """The network's probability, chunk by chunk."""
    step = quality.STRIDE
    padded = data + bytes(-len(data) % step) + bytes(step) + (b"" if data else bytes(step))
    both = np.concatenate([model["first"], model["second"]])
    answers = [model["embed"][list(padded[a : a + 2 * step])].reshape(-1) @ both for a in range(0, len(padded) - step, step)]
    hidden = np.maximum(np.maximum(np.max(answers, axis=0) + model["bias"], 0) @ model["dense"] + model["dense_bias"], 0)
    return 1 / (1 + np.exp(-float(hidden @ model["out"] + model["out_bias"] + model["prior"])))


def test_stages_against_plain_loops(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "a null id")], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd, allowMissingColumns=True)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        kept[name] = (before, after.collect())
        if name != "tokens":
            assert after.columns == docs.columns
        if name == "toxicity":
            model = toxicity.unpack(toxicity.train_toxicity(docs, labels, fold("doc_id", 3) != 1))
            scores = [plain_toxicity(t or "", model) for _, t in before]
            sure = [(i, s < toxicity.THRESHOLD) for (i, _), s in zip(before, scores, strict=True) if abs(s - toxicity.THRESHOLD) > 1e-6]
        elif name == "quality":
            model = quality.unpack(quality.train_quality(docs, labels, fold("doc_id", 5) != 0))
            scores = [plain_quality((t or "").encode(), model) for _, t in before]
            sure = [(i, s >= quality.THRESHOLD) for (i, _), s in zip(before, scores, strict=True) if abs(s - quality.THRESHOLD) > 1e-4]
        elif name == "near_duplicates":
            known = [(i, t) for i, t in before if i is not None]
            sure = [(i, i == g) for (i, _), g in zip(known, plain_groups(known, 5, 80), strict=True)]
        else:
            sure = []
        left = {r.doc_id for r in kept[name][1]}
        assert all((i in left) == stays for i, stays in sure)
        docs = after
    before, mixed = kept["mixing"]
    assert {(r.doc_id, r.text) for r in mixed} <= set(before)
    ranks = bpe.read_ranks(bpe.read_file(bpe.public_file(bpe.RANKS)))
    library = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})
    before, tokens = kept["tokens"]
    want = sorted((str(i), library.encode_ordinary(t or "")) for i, t in before)
    assert sorted((str(r.doc_id), list(r.ids)) for r in tokens) == want and all(r.round_trip for r in tokens)
    assert minhash.BANDS * minhash.ROWS == 120
