"""The numpy and Python parts by themselves, against brute force."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from gaugework.llm import ann, bpe, forest, lm, minhash, quality, token_files, toxicity


@pytest.fixture(scope="module")
def encoder():
    return bpe.transducing(bpe.read_ranks(bpe.read_file(bpe.public_file(bpe.RANKS))), bpe.public_pattern())


def test_transducer_agrees_with_the_library(encoder):
    ranks = bpe.read_ranks(bpe.read_file(bpe.public_file(bpe.RANKS)))
    library = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    texts = ["", " ", "  a  b ", "a\n\n b\n c", "x \x1cy", "x \u0085 y", "don't I'll 12 345", "漢 字字 🙂🙂", "a" * 500, "=" * 99]
    texts += ["".join(random.choice("abthe ing \n é漢1s'") for _ in range(60)) for _ in range(300)]
    table = {v: k for k, v in ranks.items()}
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), dtype="<i4").tolist()
        assert ids == library.encode_ordinary(text)
        full = [table.get(i, b"") for i in range(max(table) + 1)] if text == texts[7] else None
        if full:
            parts = list(bpe.decode_stream(ids, full, 1))
            assert b"".join(parts) == text.encode() and all(p.decode() is not None for p in parts)


def test_tokens_side_by_side_as_by_plain_merging():
    ranks = bpe.read_ranks(bpe.read_file(bpe.public_file(bpe.RANKS)))
    transducer, rng = bpe.Transducer(ranks), np.random.default_rng(3)
    tokens, above = list(ranks), len(ranks) + 256
    pairs = [(tokens[i], tokens[j]) for i, j in rng.integers(0, len(tokens), (3000, 2))]
    pairs += [(t, t) for t in tokens[::20]] + [(t[:k], t[k:]) for t in tokens[300::20] for k in range(1, len(t))]
    pairs = [(a, b) for a, b in pairs if a in ranks and b in ranks]
    expected = [transducer.merged(a + b, above) == [a, b] for a, b in pairs]
    assert expected == [transducer.may_follow(ranks[a], ranks[b]) for a, b in pairs]
    assert any(expected) and not all(expected)


def test_utf8_machine_holds_back_unfinished_characters():
    for text in ("a", "é", "漢", "🙂"):
        data = text.encode()
        for cut in range(1, len(data)):
            assert bpe.unfinished(b"x" + data[:cut]) == cut
        assert bpe.unfinished(data) == 0
    assert bpe.unfinished(b"\xff") == 0 and bpe.unfinished(b"\xe0\x80") == 0


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 9000])
def test_range_coder_round_trip_and_checksum(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.integers(0, 3, n), np.zeros(n, dtype=np.int64)):
        data = token_files.encode_segment(np.array([n]), ids)
        lengths, back = token_files.decode_segment(data)
        assert lengths.tolist() == [n] and (back == ids).all()
    if n > 100:
        broken = bytearray(data)
        broken[len(broken) // 2] ^= 0x55
        broken[40] ^= 0xFF
        with pytest.raises(ValueError):
            token_files.decode_segment(bytes(broken))


def test_ids_of_texts_with_the_marker_equal_the_library():
    with open(bpe.public_file("byte_bpe_50k.json"), "rb") as f:
        data = f.read()
    plain, encoder = Tokenizer.from_str(data.decode()), token_files.library_encoder(data)
    parts = ["<|endoftext|>", " ", "  ", "\n", "one", "two", "\t", ".", "<|", "é", "3", "'s"]
    rng = random.Random(5)
    texts = ["one <|endoftext|> two", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(2000))]
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), dtype="<i4").tolist() == ids, text


def test_coded_ids_take_fewer_bytes_than_plain_ones():
    # Ids as words have them: a few common ones, many rare ones, some in pairs.
    rng = np.random.default_rng(9)
    ids = rng.zipf(1.3, 1 << 17) * 7919 % 50_257
    ids[1::4] = ids[::4] * 31 % 50_257
    data = token_files.encode_segment(np.array([len(ids)]), ids)
    assert len(data) < 2 * len(ids)
    assert (token_files.decode_segment(data)[1] == ids).all()
    # Where nothing can be foretold, the ids cost two bytes each and little more.
    ids = rng.permutation(50_257)
    assert len(token_files.encode_segment(np.array([len(ids)]), ids)) < 2.1 * len(ids)


@pytest.mark.parametrize("most", [40, 70_000, (1 << 28) - 1])
def test_range_coder_carries_long_ids_and_refuses_longer_ones(most):
    rng = np.random.default_rng(most)
    for n in (1, 2047, 2048, 2049, 4096, 70_001):
        ids = rng.integers(0, most + 1, n)
        ids[n // 2 :] = np.resize(ids[: max(1, n // 7)], n - n // 2)
        lengths, back = token_files.decode_segment(token_files.encode_segment(np.array([n - 1, 1]), ids))
        assert lengths.tolist() == [n - 1, 1] and (back == ids).all()
    with pytest.raises(ValueError):
        token_files.encode_segment(np.array([1]), np.array([1 << 28]))


def test_cut_segments_are_errors():
    data = token_files.encode_segment(np.array([3000, 2000]), np.arange(5000) % 700)
    for end in (0, 10, 30, 60, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            token_files.decode_segment(data[:end])


def test_groups_of_texts_equal_the_library_and_take_few_calls():
    with open(bpe.public_file("byte_bpe_50k.json"), "rb") as f:
        data = f.read()
    plain, encoder = Tokenizer.from_str(data.decode()), token_files.library_encoder(data)
    rng = random.Random(11)
    ends = ["", "", "", ".", ",", "!?", "'s", "<|endoftext|>", "ª.", "中。", "3,", "\x1c", "\u3000"]
    gaps = [" "] * 12 + ["\n", "\n\n", "\n\n\n", " \n", "\n ", "  ", "\t", "\n \n", "\r\n"]
    texts = ["".join("".join(rng.choices("abcé", k=rng.randrange(1, 9))) + rng.choice(ends) + rng.choice(gaps) for _ in range(rng.randrange(30))) for _ in range(1500)]
    got = list(encoder.encode_all(texts))
    assert [np.frombuffer(g, dtype="<i4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # Words never met before are encoded together.
    calls, encode_texts = [], encoder.encode_texts
    encoder.encode_texts = lambda texts: calls.append(len(texts)) or encode_texts(texts)
    try:
        words = [" ".join("".join(rng.choices("qwxyz", k=12)) for _ in range(200)) for _ in range(20)]
        got = list(encoder.encode_all(words))
    finally:
        encoder.encode_texts = encode_texts
    assert [np.frombuffer(g, dtype="<i4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in words]
    assert sum(calls) < 100


def test_few_kept_pieces_give_the_same_ids():
    with open(bpe.public_file("byte_bpe_50k.json"), "rb") as f:
        tokenizer = Tokenizer.from_str(f.read().decode())
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randrange(1, 6))) + rng.choice(["", ".", ","]) for _ in range(60)) for _ in range(300)]
    for widths in (None, token_files.byte_widths(json.loads(tokenizer.to_str()), tokenizer.get_vocab())):
        encoder = token_files.TextEncoder(lambda t: [np.array(e.ids, dtype="<i4") for e in tokenizer.encode_batch_fast(t, add_special_tokens=False)], widths)
        encoder.most = 50
        for text in texts:
            assert np.frombuffer(encoder.encode(text), dtype="<i4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.after) < 200


def slow_super_minhash(elements, size):
    """The definition, an element at a time, without the early stop."""
    h = [np.iinfo(np.uint64).max] * size
    for x in elements:
        p = list(range(size))
        for j in range(size):
            with np.errstate(over="ignore"):
                drawn = int(minhash.mix(np.array([x], dtype=np.uint64) + minhash.GOLDEN * np.uint64(j + 1))[0])
            k = j + ((drawn & 0xFFFFFF) * (size - j) >> 24)
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], drawn >> 24 | j << 40)
    return h


def test_super_minhash_equals_its_definition():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 3, 40, 300, 0)]
    got = minhash.super_minhash(sets, 16)
    for row, s in zip(got[:4], sets, strict=False):
        assert row.tolist() == slow_super_minhash(s, 16)


def test_shingles_of_words_and_edges():
    assert len(minhash.shingle_set(b"", 2)) == 0 and len(minhash.shingle_set(b" \t\x0b", 2)) == 0
    assert len(minhash.shingle_set(b"one", 2)) == 1 and len(minhash.shingle_set(b"A b a B a b", 2)) == 2


def test_pooling_in_slices_equals_one_piece(monkeypatch):
    rng = np.random.default_rng(4)
    model = quality.fit_network([b"good text here", b"###"] * 4, [1, 0] * 4, 0.5, steps_wanted=8)
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (0, 1, 7, 8, 9, 500, 0, 3000)]
    whole = quality.score_bytes(texts, model)
    monkeypatch.setattr(quality, "SLICE", 5)
    assert np.allclose(whole, quality.score_bytes(texts, model, most=50), atol=1e-5)


def test_machine_learns_pairs_and_constants():
    texts = ["you fool"] * 30 + ["you friend"] * 30 + ["a fool"] * 30
    model = toxicity.unpack(toxicity.pack(toxicity.fit_machine(texts, [1] * 30 + [0] * 60, 1 / 3)))
    score = toxicity.score_texts(["you fool", "a fool", "you friend", "", None], model, {})
    assert score[0] > 0.7 > score[1] and score[2] < 0.5 and score[3] == score[4]
    only = toxicity.unpack(toxicity.pack(toxicity.fit_machine(["x"], [0], 0.0)))
    assert toxicity.score_texts(["x"], only, {})[0] < 1e-6


def test_machine_learns_pairs_of_words_that_tell_nothing_alone():
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(3000):
        both, toxic = i % 4 < 2, i % 2
        words = (["insult", "group"] if both else []) if toxic else ["insult"] if both else ["group"]
        texts.append(" ".join([*words, *(f"w{k}" for k in rng.integers(0, 300, 15))]))
        labels.append(toxic)
    model = toxicity.unpack(toxicity.pack(toxicity.fit_machine(texts, labels, 0.5)))
    pair, one, two = toxicity.score_texts(["insult group w1 w2 w5", "insult w1 w2 w5", "group w1 w2 w5"], model, {})
    assert pair > 0.7 and one < 0.5 and two < 0.5


def test_probabilities_are_normalised():
    model = lm.first_model(6, np.array([5, 4, 3, 2, 1, 1]))
    for one, two in ((6, 6), (2, 0)):
        every = lm.log_probabilities(np.arange(6), np.full(6, one), np.full(6, two), model)
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-6)


def test_every_word_that_is_frequent_enough_is_in_the_model():
    pairs = 2000
    common = [(i, 200) for i in range(1, 2 * pairs + 1)] + [(lm.END_HASH, 100), (-5, 20)]
    vocab = lm.Vocabulary(common, sum(c for _, c in common), len(common))
    ids = vocab.look_up(np.arange(1, 2 * pairs + 1))[0]
    assert (ids != lm.OTHER).all() and len(set(ids.tolist())) == 2 * pairs and vocab.look_up(np.array([-5]))[0][0] == lm.OTHER
    model = lm.first_model(vocab.size, vocab.own)
    size = vocab.size
    left, right = ids[:pairs], ids[pairs:]
    text = np.concatenate([np.column_stack([left, right]).ravel()] * 30)
    one, two = lm.contexts(text, size)
    lm.train_nce(((text[a : a + 4096], one[a : a + 4096], two[a : a + 4096]) for a in range(0, len(text), 4096)), model, vocab.own, 1)
    every = lm.log_probabilities(np.arange(size), np.full(size, left[-1]), np.full(size, size), model)
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)
    some = np.arange(0, pairs, 7)
    before = np.full(len(some), size)
    fits = lm.log_probabilities(right[some], left[some], before, model)
    other = lm.log_probabilities(right[some], left[some[::-1]], before, model)
    assert (fits > other).mean() > 0.9


def test_scan_finds_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, q = np.arange(3000), x[:40]
    row, col, value = ann.scan(q, np.arange(40), x, ids, 1.0, ann.rotation(33, 1), 10)
    products = q @ x.T
    products[np.arange(40), np.arange(40)] = -9
    best = np.argsort(-products, axis=1, kind="stable")[:, :10]
    hits = sum(len(set(best[i]) & set(col[row == i])) for i in range(40))
    assert hits >= 0.97 * 400 and np.allclose(value, products[row, col])


def test_local_union_find():
    roots = forest.local_roots(6, np.array([4, 2, 5]), np.array([2, 1, 5]))
    assert roots.tolist() == [0, 1, 1, 3, 1, 5]


def test_contexts_of_common_words_take_no_new_powers(monkeypatch):
    """Fails if the sum over all outputs is worked out anew for every context of two common words."""
    rng = np.random.default_rng(4)
    size = lm.HEAD + 50
    model = lm.first_model(size, rng.integers(100, 10_000, size))
    ids, one, two = (rng.integers(0, size, 5000) for _ in range(3))
    plain = model["r"][one] * model["c"][0] + model["r"][two] * model["c"][1]
    outputs = (plain @ model["q"].T + model["b"]).astype(np.float64)
    first, each = lm.outputs_of(ids, size), lm.class_size(size)
    want = outputs[np.arange(5000), first] - np.log(np.exp(outputs).sum(axis=1))
    for i in np.flatnonzero(ids >= lm.HEAD):
        begin = (first[i] - lm.HEAD) * each
        inside = model["t"][begin : begin + each].astype(np.float64)
        scores = inside[:, : lm.WIDTH] @ plain[i] + inside[:, lm.WIDTH]
        want[i] += scores[ids[i] - lm.HEAD - begin] - np.log(np.exp(scores).sum())
    powers, made, real = lm.Powers(model), [], lm.log_sums
    monkeypatch.setattr(lm, "log_sums", lambda scores, plain: made.append(scores.shape[1]) or real(scores, plain))
    assert np.allclose(lm.log_probabilities(ids, one, two, model, powers), want, atol=1e-4)
    assert len(model["q"]) not in made
    model["r"] *= 1000  # scores whose powers no float holds
    far = lm.log_probabilities(ids, one, two, model)
    assert np.isfinite(far).all() and (far < 1e-3).all() and len(model["q"]) in made


def test_sums_by_row_equal_plain_ones():
    rng = np.random.default_rng(5)
    for most in (1, 7, 900, 100_000):
        rows, values = rng.integers(0, most, 3000), rng.normal(size=(3000, 4)).astype(np.float32)
        at, sums = lm.summed(rows, values)
        want = np.zeros((most, 4))
        np.add.at(want, rows, values)
        assert at.tolist() == sorted(set(rows.tolist())) and np.allclose(sums, want[at], atol=1e-3)
