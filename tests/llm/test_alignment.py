"""Alignment of two tokenizers against the libraries and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugework.llm import alignment

SHAPE = "doc_id long, text string, batch string, N_A int"
FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(FILES[0])
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain_tokens(text, libraries):
    """((id, start, end) of A, of B) by the libraries on the whole text; none where the bytes differ."""
    one, two = libraries
    if not text:
        return [], []
    a = one.encode(" " + text, add_special_tokens=False).ids
    b = two.encode(text)
    of = {c: n for n, c in byte_characters().items()}
    bytes_a = [bytes(of[c] for c in one.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    out = []
    for ids, parts in ((a, bytes_a), (b, bytes_b)):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append([(i, e - len(p), e) for i, p, e in zip(ids, parts, ends, strict=True)])
    return out


def byte_characters():
    """The public byte-level alphabet, stated the long way."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


def plain(rows, libraries):
    made, counts = [], Counter()
    for doc_id, text in rows:
        a, b = plain_tokens(text, libraries)
        links, at = [], 0
        for i, s, e in a:
            while at < len(b) and b[at][2] <= s:
                at += 1
            k = at
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in common:
            sides = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)] if len(text) < 3000 else None
            groups.append("|".join(sides) if sides else None)
            start = end
        if None in groups:
            groups = long_groups(a, b, common)
        made.append((doc_id, len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, digest in made:
        good = sum(counts[p] == best[p[1]] for p in links)
        out.append((doc_id, n_a, n_b, n_groups, len(links), good, sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


def long_groups(a, b, common):
    out, i, j = [], 0, 0
    for end in common:
        sides = []
        for side, at in ((a, i), (b, j)):
            k = at
            while k < len(side) and side[k][2] <= end:
                k += 1
            sides.append((",".join(str(x[0]) for x in side[at:k]), k))
        (left, i), (right, j) = sides
        out.append(f"{left}|{right}")
    return out


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)
    return sorted((tuple(r) for r in alignment.alignment(docs, *FILES, **more).collect()), key=repr)


ODD = [
    "a", " ", "  ", "a ", " a", "a  b", "a\n b\n\nc", "\tx\r\n y", "<|endoftext|> is text", "one <s>two</s> <unk> <0x41>", "▁ marks", "x▁y",
    "naïve café 日本語 \U0001f600  nbsp", "it's we'll 12345 3.14", "é combining ́ alone", "\x00 zero \x1c mark", "　wide space", "ﬁ ﻿",
    "don't  stop   me", "x" * 700, "word " * 4000, "กำ" * 50,
]


def test_as_the_libraries(spark, libraries):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i, t) for i, t in enumerate([*ODD, *texts])] + [(None, "no id here"), (None, None), (7, ""), (8, "again and again"), (8, "again and again")]
    expected = plain(rows, libraries)
    assert got(spark, rows, buckets=5, slice_batches=1) == expected
    assert got(spark, rows) == expected
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_ids_are_the_libraries(libraries):
    one, two = alignment.byte_tokenizer(open(FILES[0], "rb").read()), alignment.piece_tokenizer(open(FILES[1], "rb").read())
    rng = np.random.default_rng(4)
    alphabet = list("ab e.'1\n\t   é\x1c<>|-s") + ["the", "'ll", "<s>", "日", "　", "<|endoftext|>", *map(chr, rng.integers(0x80, 0xD800, 60)), *map(chr, rng.integers(0x10000, 0x20000, 60))]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(3000)] + [" " * 300_000 + "x", "a" * 5000]
    for mine, text in zip(one.encode(texts), texts, strict=True):
        assert mine.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
    for mine, text in zip(two.encode(texts), texts, strict=True):
        assert mine.tolist() == libraries[1].encode(text)
    assert [len(x) for x in two.encode(["x▁y", "▁", "x y"])] == [0, 0, 2]


def test_merge_path_as_a_plain_merge():
    rng = np.random.default_rng(6)
    for size in (1, 2, 63, 64, 65, 500, 3000):
        for _ in range(5):
            total = size * 3
            a, b = (np.append(np.flatnonzero(rng.random(total - 1) < p) + 1, total) for p in (0.3, rng.random()))
            link_a, link_b, last_a, last_b = alignment.merge_path(a, b)
            starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
            expected, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                assert max(starts[0][i], starts[1][j]) < min(a[i], b[j])
                expected.append((i, j))
                end = min(a[i], b[j])
                i, j = i + (a[i] == end), j + (b[j] == end)
            assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == expected
            assert (last_a == np.isin(a, b)).all() and (last_b == np.isin(b, a)).all()
            at = np.arange(0, len(a) + len(b) + 1)
            assert (alignment.diagonals(a, b, at) == np.concatenate([[0], np.cumsum(np.argsort(np.concatenate([a, b]), kind="stable") < len(a))])).all()
