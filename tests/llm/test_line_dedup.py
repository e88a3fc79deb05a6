"""Line dedup against plain counting, its filters, and undoing insertions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from gaugework.llm.line_dedup import CuckooFilter, LineIndex, Shard, drop_frequent_lines

SHAPE = "doc_id long, text string, kept string, N_LINES int, key binary"
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def key(line):
    return lower(line.strip(BLANKS))


def plain(rows, counted, min_docs, min_chars):
    counts = Counter(k for _, text in counted for k in {key(line) for line in (text or "").split("\n")} if len(k) >= min_chars)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [line for line in lines if counts[key(line)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1, b"x") for r in rows], SHAPE)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines_", "n_dropped", "kept_").collect()), key=repr)


def rows_of(seed, n):
    rng = random.Random(seed)
    common = ["License X", "license x ", "\tLICENSE X\r", "Ünïcode Ä", "ünïcode ä", "", "  ", "A\x1c", "z" * 5000, " nbsp"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.4 else f"Own {rng.randrange(40)} {i % 3}" for _ in range(rng.randrange(1, 9)))) for i in range(n)]
    return rows + [(None, "License X\nlost id"), (None, None), (1, None), (2, ""), (3, "\n\n"), (4, "License X"), (4, "License X"), (5, "one\r\ntwo\r\n" * 3000)]


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 4), (1, 1)])
def test_as_plain_counting(spark, min_docs, min_chars):
    rows = rows_of(3, 60)
    left = drop_frequent_lines(table(spark, rows), min_docs, min_chars)
    assert left.columns == ["doc_id", "text", "kept", "N_LINES", "key", "n_lines_", "n_dropped", "kept_"]
    assert got(left) == plain(rows, rows, min_docs, min_chars)


def test_empty_table(spark):
    assert drop_frequent_lines(table(spark, [])).count() == 0
    index = LineIndex.empty(spark).insert(table(spark, []))
    assert index.filters.count() == 0 and got(index.apply(table(spark, [(1, "a\nb")]))) == [(1, 2, 0, "a\nb")]


def test_insertions_and_deletions(spark):
    first, second = rows_of(5, 50), rows_of(6, 50)
    asked = first[:20] + second[:20]
    one = LineIndex.empty(spark, 12, 1, shards=3).insert(table(spark, first))
    both = one.insert(table(spark, second))
    back = both.delete(table(spark, second))
    for index, counted in ((one, first), (both, first + second), (back, first)):
        assert got(index.apply(table(spark, asked))) == plain(asked, counted, 12, 1)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, one.counts.collect()))
    # The filters hold as many marks as there are frequent lines.
    for index in (one, both, back):
        marks = sum(int((f.table > 0).sum()) for r in index.filters.collect() for f in Shard(bytes(r.data)).filters)
        assert marks == index.counts.where("n_docs >= 12").count()
    nothing = back.delete(table(spark, first))
    assert nothing.counts.count() == 0 and got(nothing.apply(table(spark, asked))) == plain(asked, [], 12, 1)
    with pytest.raises(ValueError):
        nothing.delete(table(spark, first[:1]))


def test_filter_never_loses_a_key():
    rng = np.random.default_rng(2)
    places, marks = rng.integers(0, 1 << 32, 20_000), rng.integers(1, 65_536, 20_000)
    shard = Shard()
    for p, m in zip(places.tolist(), marks.tolist(), strict=True):
        shard.add(p, m)
    assert len(shard.filters) > 1 and shard.holds(places, marks).all()
    again = Shard(shard.data())
    for p, m in zip(places[:10_000].tolist(), marks[:10_000].tolist(), strict=True):
        again.remove(p, m)
    assert again.holds(places[10_000:], marks[10_000:]).all()
    assert again.holds(places[:10_000], marks[:10_000]).mean() < 0.02
    for p, m in zip(places[10_000:].tolist(), marks[10_000:].tolist(), strict=True):
        again.remove(p, m)
    assert all(not f.table.any() for f in again.filters)


def test_full_filter_stays_as_it_was():
    small = CuckooFilter(2)
    added = [m for m in range(1, 40) if small.add(m * 7, m)]
    before = small.table.copy()
    assert not small.add(3, 60_000) and (small.table == before).all() and len(added) <= 8
