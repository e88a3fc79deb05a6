"""The Merkle manifest against a plain tree over lists."""

from __future__ import annotations

import hashlib
import zlib

from gaugework.llm import merkle

SHAPE = "doc_id long, source string, lang string, n_chars int, text string, root string, _SUBROOT int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
    return h("".join(parts))


def tree(digests):
    """The root and, per node, its (left, right) siblings level by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            run = digests[place // 16 * 16 : place // 16 * 16 + 16]
            paths[i].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        digests = [h("".join(digests[i : i + 16])) for i in range(0, len(digests), 16)]
        at = [place // 16 for place in at]
    return digests[0], paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """The rows of the query, by lists."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for source in sources:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        made[source] = (mine, *tree([leaf(r, r[4]) for r in mine]))
    root, tops = tree([made[s][1] for s in sources])
    out = []
    for source, above in zip(sources, tops, strict=True):
        mine, subroot, paths = made[source]
        for row, path in zip(mine, paths, strict=True):
            steps = path + above
            drawn = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            digest = leaf(row, lowered(row[4]) if drawn else row[4])
            for left, right in steps:
                digest = h(left + digest + right)
            out.append((row[0], leaf(row, row[4]), subroot, root, h("".join(a + b for a, b in steps)), digest, digest == root))
    return sorted(out, key=repr)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)
    return sorted((tuple(r) for r in merkle.tampered_manifest(docs).collect()), key=repr)


def test_small_and_odd_rows(spark):
    rows = [(i, "a", "en", 3, f"Text {i}") for i in range(40)] + [
        (None, "a", "en", 3, "no id"),
        (7, "a", "en", 3, "Text 7"),
        (7, "a", "en", 3, "another Text"),
        (100, None, None, None, None),
        (101, None, None, None, ""),
        (102, "Ähnlich", "de", -5, "Ünïcode ABC"),
        (103, "", "de", 0, "LONG " * 50_000),
        (-4, "z", "de", 0, "A"),
    ]
    mine = got(spark, rows)
    assert mine == plain(rows)
    assert not all(r[-1] for r in mine) and any(r[-1] for r in mine)


def test_a_lone_row_and_none(spark):
    assert got(spark, [(5, "a", "en", 1, "A")]) == plain([(5, "a", "en", 1, "A")])
    assert got(spark, []) == []


def test_several_blocks_and_many_sources(spark):
    rows = [(i, "hot", "en", 1, f"T{i}") for i in range(8193)] + [(i, f"s{i:05d}", "en", 1, "T") for i in range(9000, 13200)]
    assert got(spark, rows) == plain(rows)


def test_general_columns(spark):
    docs = spark.createDataFrame([(i, None, "en", 1, f"t{i}", "mine", 4) for i in range(20)], SHAPE)
    made = merkle.merkle_manifest(docs.withColumn("d", merkle.document_leaf(docs["text"])), "source", "d", ["doc_id"])
    assert made.columns == [*docs.columns, "d", "subroot", "root_", "witness"]
    seen = made.selectExpr("root", "_SUBROOT", "root_", "subroot", "size(witness) AS steps").distinct().collect()
    assert len(seen) == 1 and seen[0].root == "mine" and seen[0].root_ == seen[0].subroot and seen[0].steps == 2
