"""Near-duplicate documents by SuperMinHash signatures, bands and verified links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents, fresh, slices, text_bytes
from gaugework.llm.components import merged
from gaugework.session import cut_lineage, scope, scratch_path

# At a similarity of 0.8 a pair shares none of the bands with a probability of 1 in 14,000.
BANDS = 24
ROWS = 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PRODUCTIVE = 0.1  # share of links among tried pairs up to which another leader is worth a try
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # sets, and hashes in them, of one side of a comparison of blocks
CELLS = 4_000_000  # cells of the incidence matrices that a task holds at once
PIECE = 60_000  # shingles whose permutations a task works on at once


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text
    of fewer words has one shingle, one without words has none.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    width = min(words, len(hashes))
    last = len(hashes) - width + 1
    joined = mix(hashes[:last] + np.uint64(width))
    for i in range(1, width):
        joined = mix(joined * GOLDEN + hashes[i : i + last])
    return np.unique(joined)


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures of sets of hashes, one row each.

    Step j draws for each element a number in [j, j + 1) and the j-th place of its random
    permutation of the components; a component keeps the smallest number dealt to it.
    A set is done as soon as its largest component is below the next step. A number is
    the step in the upper 24 bits over 40 random bits.
    """
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, dtype=np.uint64)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    if not lengths.sum():
        return out
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    flat = out.reshape(-1)
    places: np.ndarray | None = None
    for j in range(size):
        with np.errstate(over="ignore"):
            drawn = mix(elements + GOLDEN * np.uint64(j + 1))
        k = j + (((drawn & np.uint64(0xFFFFFF)) * np.uint64(size - j)) >> np.uint64(24)).astype(np.int64)
        value = (drawn >> np.uint64(24)) | np.uint64(j << 40)
        if places is None:
            component = k
        else:
            row = np.arange(len(elements))
            component = places[row, k].astype(np.int64)
            places[row, k] = places[:, j]
            places[row, j] = component
        np.minimum.at(flat, owner * size + component, value)
        open_ = out.max(axis=1) >= np.uint64((j + 1) << 40)
        stay = open_[owner]
        if not stay.any():
            break
        if places is None:
            places = np.broadcast_to(np.arange(size, dtype=np.uint16), (int(stay.sum()), size)).copy()
            elements, owner, k = elements[stay], owner[stay], k[stay]
            row = np.arange(len(elements))
            places[row, k] = 0
            places[row, 0] = k
        elif stay.mean() < 0.7:
            elements, owner, places = elements[stay], owner[stay], places[stay]
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, bands) of every row; without shingles digest and bands are null.

    ``digest`` is a 128-bit hash of the whole set, so that equal sets meet at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, sizes, digests, signed = [], [], [], []
            pending = 0

            def sign():
                rows = super_minhash(sets, BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
                for r in range(ROWS):
                    keys = mix(keys * GOLDEN + rows[:, :, r])
                signed.append(keys.view(np.int64))
                sets.clear()

            for text in text_bytes(batch.column(2)):
                found = shingle_set(text, words)
                sets.append(found)
                sizes.append(len(found))
                digests.append(set_digest(found))
                pending += len(found)
                if pending > PIECE:
                    sign()
                    pending = 0
            if sets:
                sign()
            keys, empty = np.concatenate(signed), np.array(sizes) == 0
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)), mask=pa.array(empty))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "bands"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return plain.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>")


def set_digest(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) with the full set of hashes of each row (node, digest, text) whose set has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in text_bytes(batch.column(2))]
            meant = [set_digest(s) == d for s, d in zip(sets, batch.column(1).to_pylist(), strict=True)]
            shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), shingles], ["node", "shingles"]).filter(pa.array(meant))

    return docs.mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(two, "b").join(one, "a").where(100 * both >= percent * union).select("a", "b")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right.

    Incidence matrices over the hashes that stand on both sides are multiplied, a slice of
    the hashes at a time.
    """
    out = np.zeros((len(left), len(right)))
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    if not len(shared):
        return out
    places = []
    for values, owner in sides:
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        here = shared[at] == values
        at, owner = at[here], owner[here]
        order = np.argsort(at, kind="stable")
        places.append((at[order], owner[order]))
    width = max(64, CELLS // (len(left) + len(right)))
    for low in range(0, len(shared), width):
        high = min(low + width, len(shared))
        dense = []
        for (at, owner), rows in zip(places, (len(left), len(right)), strict=True):
            first, last = np.searchsorted(at, [low, high])
            matrix = np.zeros((rows, high - low), dtype=np.float32)
            matrix[owner[first:last], at[first:last] - low] = 1
            dense.append(matrix)
        out += dense[0] @ dense[1].T
    return out


def spanning(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of components that connect all that ``pairs`` connect, without those that close a circle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        one, two = root(a), root(b)
        if one != two:
            parent[one] = two
            out.append((a, b))
    return out


def blocks_compared(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that a link joins, for neighbourhoods that hold several components.

    ``apart`` has (leader, node, n, component). Inside a neighbourhood the members outside its
    most frequent component are compared with all members, block by block: a task holds two blocks of at most
    about ``BLOCK`` sets or ``BLOCK_SHINGLES`` hashes and returns fewer pairs than it holds components. A set is
    shipped once per block of the other side, and no pair of documents becomes a row.
    """
    shares = apart.groupBy("leader", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    best = F.max(F.struct("c", "component"))
    hoods = shares.groupBy("leader").agg(best.alias("best"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    inside = shares.join(hoods.select("leader", F.col("best.component").alias("most")), "leader").where("component <> most")
    outer = inside.groupBy("leader").agg(F.sum("c").alias("oc"), F.sum("s").alias("os"))

    def number(count: str, total: str):
        return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")

    grid = hoods.join(outer, "leader").select(
        "leader", F.col("best.component").alias("most"), number("oc", "os").alias("rows"), number("c", "s").alias("columns")
    )
    grid = cut_lineage(grid, "grid")
    placed = apart.join(grid, "leader").join(sets, "node")
    spot = F.xxhash64("node")
    kinds = [
        (placed.where("component <> most"), F.lit(True), F.pmod(spot, "rows"), F.sequence(F.lit(0), F.col("columns") - 1)),
        (placed, F.lit(False), F.pmod(spot, "columns"), F.sequence(F.lit(0), F.col("rows") - 1)),
    ]
    sides = []
    for rows, outside, own, others in kinds:
        dealt = rows.select("leader", outside.alias("outside"), own.alias("own"), F.explode(others).alias("other"), "component", "shingles")
        i, j = (F.col("own"), F.col("other")) if not sides else (F.col("other"), F.col("own"))
        sides.append(dealt.select("leader", i.cast("long").alias("i"), j.cast("long").alias("j"), "outside", "component", "shingles"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        outside = table.column("outside").to_numpy()
        names = table.column("component").to_numpy()
        sets = [np.asarray(x.values).view(np.uint64) for x in table.column("shingles")]
        left, right = [sets[k] for k in np.flatnonzero(outside)], [sets[k] for k in np.flatnonzero(~outside)]
        found = np.zeros((0, 2), dtype=np.int64)
        if left and right:
            both = intersections(left, right)
            sizes = [np.array([len(s) for s in side], dtype=np.float64) for side in (left, right)]
            union = sizes[0][:, None] + sizes[1][None, :] - both
            one, two = names[outside], names[~outside]
            x, y = np.nonzero((100 * both >= percent * union) & (one[:, None] != two[None, :]))
            found = np.unique(np.sort(np.stack([one[x], two[y]], axis=1), axis=1), axis=0)
        joined = np.array(spanning(found), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(joined[:, 0], pa.int64()), "b": pa.array(joined[:, 1], pa.int64())})

    both = sides[0].unionByName(sides[1])
    wide = both.groupBy("leader", "i", "j").applyInArrow(run, "a long, b long")
    return wide.distinct()


def classes_of(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, first_hash) of every row of ``docs`` (doc_id, text).

    Equal sets are one class with a number of its own. Classes that share a band are
    candidates, and no bucket is expanded into its pairs: all classes that share a band with a bucket's leader are a
    neighbourhood, and every member is verified against the leader that it meets in most bands. As long as that links
    many, members of neighbourhoods that still hold several components try another leader; what
    is still apart after that is compared in blocks, so that every candidate pair is verified or already connected.
    ``first_hash`` tells which text of ``component_id`` leads the component, where that id has several.
    """
    spark = docs.sparkSession
    signed = cut_lineage(signatures(docs, words), "signed")
    named = scratch_path(spark, "named")
    with scope(spark):
        usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        lowest = F.min(F.struct("doc_id", "text_hash"))
        classes = usable.groupBy("digest").agg(lowest.alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"),
                                               F.first("n_shingles").alias("n"))
        # The numbers are written before they are used, so that a repeated task cannot change them.
        classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        banded = classes.select("node", "n", F.explode("bands").alias("band"))
        buckets = banded.groupBy("band").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("f"))
        buckets = buckets.where("members > 1").select("band", F.col("f.node").alias("leader"))
        members = banded.join(buckets, "band").groupBy("leader", "node", "n").agg(F.count("*").alias("times"))
        members = cut_lineage(members, "members")

        needed = members.select("node").distinct().join(classes.select("node", "digest", "first"), "node")
        needed = needed.select("node", "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        texts = texts.join(needed, ["doc_id", "text_hash"]).select("node", "digest", "text")
        sets = cut_lineage(shingle_sets(texts, words).dropDuplicates(["node"]), "sets")

        def ends(one: str, two: str) -> list:
            return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]

        chosen = members.where("node <> leader").groupBy("node").agg(F.max(F.struct("times", "leader")).alias("c"))
        tested = cut_lineage(chosen.select(*ends("node", "c.leader")).distinct(), "pairs")
        alone = sets.select("node", F.col("node").alias("component"))
        labels = merged(alone, verified(tested, sets, percent))
        turn, share = 0, 1.0
        while True:
            turn += 1
            labelled = members.join(labels, "node").select("leader", "node", "n", "component")
            mixed = labelled.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            mixed = mixed.where("low <> high").select("leader")
            apart = cut_lineage(labelled.join(mixed, "leader", "left_semi"), "apart")
            if apart.isEmpty():
                break
            if share < PRODUCTIVE:
                labels = merged(labels, blocks_compared(apart, sets, percent))
                break
            draw = F.xxhash64("leader", "node", F.lit(turn))
            next_ = apart.groupBy("leader").agg(F.min(F.struct(draw.alias("h"), "node", "n", "component")).alias("f"))
            next_ = cut_lineage(next_.select("leader", *[F.col(f"f.{c}").alias(f"{c}_1") for c in ("node", "n", "component")]), "leaders")
            met = apart.join(next_, "leader").where("component <> component_1")
            met = met.where(f"100 * least(n, n_1) >= {percent} * greatest(n, n_1)")
            # A member tries one leader a turn: of those it may link with, the one that a hash names.
            chosen = met.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "node_1").alias("h"), "node_1")).alias("c"))
            pairs = cut_lineage(chosen.select(*ends("node", "c.node_1")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            tried = pairs.count()
            found = cut_lineage(verified(pairs, sets, percent), "links")
            tested, labels = tested.unionByName(pairs), merged(labels, found)
            share = found.count() / tried if tried else 0.0

        grouped = classes.join(labels, "node", "left").select("digest", "first", "copies", F.coalesce("component", "node").alias("component"))
        firsts = grouped.groupBy("component").agg(F.min("first").alias("lead"), F.sum("copies").alias("rows"))
        firsts = firsts.where("rows > 1")
        grouped.join(firsts, "component").select("digest", "lead").write.parquet(named)
    out = signed.join(spark.read.parquet(named), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lead.doc_id", "doc_id"))
    first = F.coalesce("lead.text_hash", "text_hash")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), first.alias("first_hash"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Two texts are linked if their sets of ``words``-word shingles have 100 * intersection >= ``percent`` * union.
    A null or empty text has no shingles and is linked with nothing. A null id takes no part:
    its component is null and it is kept. Rows are repeated by id: each text of a repeated id counts
    for itself. An empty table gives an empty one; other columns are left aside.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return classes_of(docs, words, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op5_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=2, percent=80)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(2, len(w)))) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT r.node, l.b FROM reached r JOIN both_ways l ON r.other = l.a
), lowest AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN lowest ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but one per group of near duplicates, with their columns.

    The row of the smallest id stays; of several rows with that id and that text, one stays. Texts
    that share an id but are no near duplicates stay both, as do rows with a null id
    and rows without a word.
    """
    grouped = cut_lineage(classes_of(docs.select("doc_id", "text"), words, percent), "groups")
    grouped = grouped.where("doc_id IS NOT NULL AND n_shingles > 0")
    leads = F.expr("doc_id = component_id AND text_hash = first_hash")
    key, text = fresh(docs, "text_hash"), F.xxhash64("text")
    gone = grouped.where(~leads).select("doc_id", F.col("text_hash").alias(key)).distinct()
    marked = docs.withColumn(key, text)
    left = marked.join(gone, ["doc_id", key], "left_anti")
    repeated = grouped.where(leads).groupBy("doc_id", F.col("text_hash").alias(key)).agg(F.count("*").alias("c")).where("c > 1")
    repeated = cut_lineage(repeated.select("doc_id", key), "repeated")
    if not repeated.isEmpty():
        single = left.join(repeated, ["doc_id", key], "left_anti")
        left = single.unionByName(left.join(repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]))
    return left.select(*docs.columns)
