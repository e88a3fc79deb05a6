"""A Merkle manifest of a dataset: one 16-ary tree per source under one root, a witness per row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents, fresh
from gaugework.session import cut_lineage, number_rows

ARITY = 16
RISE = 3  # levels that one block rises
BLOCK = ARITY**RISE
DIGEST = 64  # hex digits
WITNESS = "array<struct<left:string,right:string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_digest(witness: Column) -> Column:
    """The digest of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""), 256)


class Node:
    __slots__ = ("digest", "left", "right", "up")

    def __init__(self, digest: str):
        self.digest, self.up = digest, None

    def witness(self) -> list[tuple[str, str]]:
        """(left siblings, right siblings) of every level from here to the top."""
        steps, node = [], self
        while node.up is not None:
            steps.append((node.left, node.right))
            node = node.up
        return steps


class Witnesses:
    """Nodes appended one after another to an aligned tree of ``height`` levels.

    Every level holds its open run. The sibling that completes a run extends the
    witnesses of all its nodes at once: the leaves below share the step, since they reach it
    through ``up``. The run's digest is then appended a level higher.
    """

    def __init__(self, height: int):
        self.open: list[list[Node]] = [[] for _ in range(height)]
        self.top: Node | None = None

    def append(self, node: Node, level: int = 0) -> None:
        if level == len(self.open):
            self.top = node
            return
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self.complete(level)

    def complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        joined = "".join([n.digest for n in run])
        up = Node(sha(joined))
        for i, node in enumerate(run):
            node.left, node.right, node.up = joined[: DIGEST * i], joined[DIGEST * (i + 1) :], up
        self.append(up, level + 1)

    def close(self) -> Node:
        """Complete the open runs, the lowest first; the top comes back."""
        for level, run in enumerate(self.open):
            if run:
                self.complete(level)
        return self.top


def height(nodes: int) -> int:
    """Levels from ``nodes`` aligned nodes to one, or to the root of each block where one block is too small."""
    levels = 0
    while levels < RISE and ARITY**levels < nodes:
        levels += 1
    return levels


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The slices of each block, from batches sorted by group and block (their first two columns)."""
    held, now = [], None
    for batch in batches:
        start = 0
        for at, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != now:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield held
                held, now, start = [], key, at
        if len(batch) > start:
            held.append(batch.slice(start))
    if held:
        yield held


def grown(digests: list[str], total: int) -> tuple[list[Node], Node]:
    tree, nodes = Witnesses(height(total)), [Node(d) for d in digests]
    for node in nodes:
        tree.append(node)
    return nodes, tree.close()


def in_blocks(nodes: DataFrame, *columns: str) -> DataFrame:
    """Nodes block by block: partitions hold whole blocks, in the order of their places."""
    cut = nodes.select("_group", F.floor(F.col("_place") / BLOCK).alias("_block"), "_place", *columns)
    return cut.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_place")


def block_roots(nodes: DataFrame) -> DataFrame:
    """One node a level up for every block of a group's nodes; the roots are the next level's appends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks(batches):
            table = pa.Table.from_batches(held)
            total = table.column("_n")[0].as_py()
            _, top = grown(table.column("_digest").to_pylist(), total)
            values = [table.column("_group")[0].as_py(), table.column("_block")[0].as_py(), -(-total // BLOCK), top.digest]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["_group", "_place", "_n", "_digest"])

    return in_blocks(nodes, "_n", "_digest").mapInArrow(run, "_group string, _place long, _n long, _digest string")


def witnessed(nodes: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of every node and ``_witness``: its steps inside its block, then those ``above``.

    ``above`` has one row per block (_group, _place, _witness); it travels as the block's first row.
    """
    heads = above.withColumn("_place", F.col("_place") * BLOCK).withColumn("_head", F.lit(0))
    rows = nodes.withColumn("_head", F.lit(1))
    both = rows.unionByName(heads, allowMissingColumns=True)
    own = ["_place", "_head", "_n", "_digest", "_witness"]
    more = [c for c in keep if c not in ("_group", *own)]
    cut = both.select("_group", F.floor(F.col("_place") / BLOCK).alias("_block"), *own, *more)
    cut = cut.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_head", "_place")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keep).schema) + f", _witness {WITNESS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks(batches):
            table = pa.Table.from_batches(held)
            over = [(s["left"], s["right"]) for s in table.column("_witness")[0].as_py()]
            table = table.slice(1)
            made, _ = grown(table.column("_digest").to_pylist(), table.column("_n")[0].as_py())
            ends, left, right = [0], [], []
            for node in made:
                steps = node.witness() + over
                left += [s[0] for s in steps]
                right += [s[1] for s in steps]
                ends.append(len(left))
            steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
            kept = [table.column(c).combine_chunks() for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, witness], [*keep, "_witness"])

    return cut.mapInArrow(run, out)


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their block roots, the roots of blocks of those, until every group has one node."""
    levels, widest = [nodes], nodes.agg(F.max("_n")).first()[0] or 0
    while widest > 1:
        levels.append(cut_lineage(block_roots(levels[-1]), "merkle-roots"))
        widest = -(-widest // BLOCK)
    return levels


def descended(levels: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """The witnesses of the lowest level, from those of the single nodes at the top (_group, _place, _witness)."""
    for nodes in reversed(levels[1:-1] if len(levels) > 1 else []):
        above = witnessed(nodes, above, ["_group", "_place"])
    return witnessed(levels[0], above, keep)


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """Add the row's place in its ``_group`` and the group's size, by a global sort that no group bounds."""
    numbered = number_rows(df, [F.col(c).asc_nulls_first() for c in ["_group", *order]], "_number")
    sizes = numbered.groupBy(F.col("_group").alias("_of")).agg(F.min("_number").alias("_first"), F.count("*").alias("_n"))
    joined = numbered.join(sizes, F.col("_group").eqNullSafe(F.col("_of")))
    return joined.withColumn("_place", F.col("_number") - F.col("_first")).drop("_of", "_first", "_number")


def merkle_manifest(rows: DataFrame, source: str, leaf: str, order: list[str]) -> DataFrame:
    """``rows`` with ``subroot`` (of the row's source), ``root`` and ``witness``.

    ``leaf`` holds a row's digest in hex. Per source the leaves ascend by ``order`` (nulls first)
    and then by the leaf, so ties and repeated rows have a defined place: rows that agree in all of these are
    alike, and their witnesses are dealt to them in any order. A null source is a source of its own and comes first; an
    empty table stays empty. Added names that ``rows`` has already get underscores.

    Blocks of 4,096 aligned leaves grow in separate tasks, which stream them; their roots are appended to the
    next level as further leaves. Then the witnesses come down, one row per block and level.
    """
    names = [fresh(rows, n) for n in ("subroot", "root", "witness")]
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    packed = rows.select(F.col(source).cast("string").alias("_group"), F.col(leaf).alias("_digest"), F.struct("*").alias("_row"), *keys)
    leaves = cut_lineage(placed(packed, [f"_by{i}" for i in range(len(keys))] + ["_digest"]), "merkle-leaves")
    levels = levels_of(leaves)
    # The subroots, in the order of their sources, are the leaves of one more tree.
    tops = levels[-1].select(F.col("_group").alias("_source"), "_digest", F.col("_digest").alias("_subroot"))
    subroots = cut_lineage(placed(tops.withColumn("_group", F.lit(None).cast("string")), ["_source"]), "merkle-subroots")
    upper = levels_of(subroots)
    root = upper[-1].agg(F.max("_digest")).first()[0]
    summit = upper[-1].select("_group", "_place", F.expr(f"CAST(array() AS {WITNESS})").alias("_witness"))
    above = descended(upper, summit, ["_source", "_subroot"])
    above = above.select(F.col("_source").alias("_group"), F.lit(0).cast("long").alias("_place"), "_witness", "_subroot")
    above = cut_lineage(above, "merkle-above")
    low = descended(levels, above.drop("_subroot"), ["_row", "_group"])
    # One row per source, of a size that adaptive execution measures.
    by_source = above.select(F.col("_group").alias("_of"), "_subroot")
    joined = low.join(by_source, F.col("_group").eqNullSafe(F.col("_of")))
    added = (F.col("_subroot"), F.lit(root), F.col("_witness"))
    return joined.select("_row.*", *[c.alias(n) for c, n in zip(added, names, strict=True)])


def document_leaf(text: Column) -> Column:
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and what a check by witness says where every fifth text was lower-cased.

    A null id is never tampered with; null texts stay null; a text without capitals is not changed by it.
    """
    drawn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaf = document_leaf(F.col("text"))
    changed = F.when(drawn, document_leaf(F.translate("text", CAPITALS, SMALL))).otherwise(F.lit(None))
    thin = docs.select("doc_id", "source", leaf.alias("leaf"), changed.alias("tampered"))
    made = merkle_manifest(cut_lineage(thin, "merkle-digests"), "source", "leaf", ["doc_id"])
    told = made.withColumn("proof_sha256", proof_digest(F.col("witness")))
    told = told.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("witness")))
    out = told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir):
    """One row per document; nulls, repeats and ties as ``merkle_manifest`` and ``tampered_manifest`` say."""
    return tampered_manifest(documents(spark, sf_dir))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_levels(name: str, group: str, count: int) -> str:
    """Levels 0 to ``count`` of a tree: every node with its siblings; one remaining node stays as it is."""
    out = []
    for k in range(count):
        joined = f"string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY {group}, pos // {ARITY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        out.append(f"{name}{k}s AS (SELECT *, {joined} AS joined FROM {name}{k})")
        out.append(
            f"{name}{k + 1} AS (SELECT {group}, pos // {ARITY} AS pos, (any_value(n) + {ARITY - 1}) // {ARITY} AS n, "
            f"CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(any_value(joined)) END AS digest FROM {name}{k}s GROUP BY {group}, pos // {ARITY})"
        )
    return ",\n".join(out)


_CRC = (
    "xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split({0}, '')], "
    "lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT FOR i IN range(8)], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)


def _sql_climb(start: str, name: str, on: str, pos: str, count: int) -> tuple[str, str]:
    """Tables that take ``folded`` and ``proof`` up the levels of a tree, and the last one's name."""
    steps, now = [], start
    for k in range(count):
        t = f"{name}{k}s"
        left = f"left({t}.joined, {DIGEST} * ({t}.pos % {ARITY})::INT)"
        right = f"substr({t}.joined, {DIGEST} * ({t}.pos % {ARITY})::INT + {DIGEST + 1})"
        steps.append(
            f"{start}_{name}{k} AS (SELECT f.* REPLACE ("
            f"CASE WHEN {t}.n = 1 THEN f.folded ELSE sha256({left} || f.folded || {right}) END AS folded, "
            f"CASE WHEN {t}.n = 1 THEN f.proof ELSE f.proof || {left} || {right} END AS proof) "
            f"FROM {now} f JOIN {t} ON {on.format(t)} AND {t}.pos = f.{pos} // {ARITY**k})"
        )
        now = f"{start}_{name}{k}"
    return ",\n".join(steps), now


def _sql(below: int = 5, over: int = 3) -> str:
    """For up to 16 to the power of ``below`` rows a source and of ``over`` sources."""
    lower, last = _sql_climb("f", "t", "{}.source IS NOT DISTINCT FROM f.source", "pos", below)
    upper, top = _sql_climb(last, "u", "TRUE", "spos", over)
    return f"""
WITH leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
               CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} END AS tampered
        FROM documents)
), t0 AS (SELECT source, pos, n, leaf AS digest FROM leaves),
{_sql_levels("t", "source", below)},
u0 AS (
  SELECT 0 AS one, source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest FROM t{below}
),
{_sql_levels("u", "one", over)},
f AS (
  SELECT l.doc_id, l.source, l.leaf, l.pos, s.digest AS subroot, s.pos AS spos, coalesce(l.tampered, l.leaf) AS folded, '' AS proof
  FROM leaves l JOIN u0 s ON s.source IS NOT DISTINCT FROM l.source
),
{lower},
{upper}
SELECT f.doc_id, f.leaf, f.subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.digest AS verified
FROM {top} f CROSS JOIN u{over} r
"""


OP11_SQL = _sql()
