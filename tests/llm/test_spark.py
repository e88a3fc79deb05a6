"""The operators on small tables with nulls, empty texts, copies and clashing names."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gaugework.llm import ann, bpe, common, components, forest, lm, minhash, mixing, quality, sharding, token_files, toxicity
from gaugework.llm.common import fold
from gaugework.session import scratch_path

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "s1"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "s1"),
    (3, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "s1"),
    (4, "something else altogether stands in this text", None),
    (5, "", "s2"),
    (6, None, "s2"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "s2"),
    (8, "word " * 3000, "s2"),
    (9, "one", "s2"),
    (9, "one", "s2"),
]
SHAPE = "doc_id long, text string, source string, score double, ids string, kept int"


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0.0, "x", 1) for r in rows], SHAPE)


def test_near_duplicates(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(table(spark), 2, 80).collect()}
    assert got[1, 9] == (1, True) and got[2, 9] == (1, False) and got[3, 10] == (1, False)
    assert got[4, 6] == (4, True) and got[5, 0] == (5, True) and got[6, 0] == (6, True)
    assert got[None, 9] == (None, True) and got[8, 1] == (8, True) and got[9, 1] == (9, True)
    left = minhash.one_of_each(table(spark), 2, 80)
    assert left.columns == table(spark).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "5", "6", "8", "9", "None"]
    assert minhash.near_duplicates(table(spark, []), 2, 80).count() == 0


def plain_groups(rows, words, percent):
    """Component of every row (id, text) by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        found = (text or "").lower().split()
        width = min(words, len(found))
        sets.append({tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return [min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group]


def test_near_copies_on_both_sides_of_the_limit(spark, monkeypatch):
    """A large neighbourhood, some of its pairs linked and some not, in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "CELLS", 4096)
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        text = list(base)
        for k in draw.choice(60, size=int(draw.integers(1, 9)), replace=False):
            text[k] = f"x{draw.integers(10**6)}"
        rows.append((1000 + i, " ".join(text)))
    want = dict(zip([r[0] for r in rows], plain_groups(rows, 2, 80), strict=True))
    assert 10 < len(set(want.values())) < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for productive in (0.1, 2.0):
        monkeypatch.setattr(minhash, "PRODUCTIVE", productive)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2, 80).collect()}
        assert sum(got[i] != want[i] for i in got) <= 2  # bands miss a pair at the limit now and then


def test_intersections_equal_those_of_sets():
    draw = np.random.default_rng(3)
    sides = [[np.unique(draw.integers(0, 500, size=n).astype(np.uint64)) for n in draw.integers(0, 90, size=k)] for k in (7, 11)]
    got = minhash.intersections(*sides)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1]] for a in sides[0]]


def test_different_texts_of_one_id(spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one), (1, two), (1, two), (2, one), (3, two), (4, ""), (4, ""), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in minhash.one_of_each(docs, 5, 80).collect()), key=str)
    assert left == sorted([(1, one), (1, two), (4, ""), (4, ""), (None, one)], key=str)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {50: 50, 51: 50}


def test_components_of_large_ids(spark):
    most = 2**63 - 1
    links = spark.createDataFrame([(most - i, most - i - 1) for i in range(8)] + [(-(2**63), -(2**63) + 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {most - i: most - 8 for i in range(9)} | {-(2**63): -(2**63), -(2**63) + 5: -(2**63)}


def test_links_merge_into_earlier_components(spark):
    labels = spark.range(10).select(F.col("id").alias("node"), F.col("id").alias("component"))
    for links in ([(9, 8), (7, 8), (3, 4), (4, 4)], [(7, 4), (0, 1)], []):
        labels = components.merged(labels, spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in labels.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 3, 8: 3, 9: 3}


def test_shards_fit_and_hold_every_row(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('x', CAST(id % 40 AS INT)) AS text", "'s' AS source")
    got = sharding.extendible_shards(docs, 1000).collect()
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert len(got) == 500 and all(v <= 1000 for v in sums.values()) and all(sums[r.shard] == r.shard_bytes for r in got)
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    odd = sharding.extendible_shards(table(spark), 100).collect()
    assert len(odd) == len(ROWS) and max(r.shard_rows for r in odd if r.shard_bytes > 100) <= 2
    assert sharding.extendible_shards(table(spark, []), 100).count() == 0


def test_mixing_meets_the_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "IF(id % 6 = 0, 'a', 'b') AS source", "1 AS copy")
    got = mixing.poisson_mix(docs, {"a": 3.0, "b": 1.0})
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["a"] - 4500) < 350 and abs(counts["b"] - 1500) < 200 and "copy_" in got.columns
    assert mixing.poisson_mix(table(spark, [])).count() == 0
    assert mixing.poisson_mix(table(spark), {"s1": 200.0}).where("source IS NULL OR source <> 's1'").count() == 0


def test_classifiers_on_odd_rows(spark):
    rows = [(i, "scum of the earth" if i % 2 else "a pleasant day", "s") for i in range(200)] + ROWS[4:7]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    docs = table(spark, rows)
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and clean.where("text LIKE 'scum%'").count() == 0
    assert clean.where("text LIKE 'a pl%'").count() == 100
    good = quality.drop_poor(docs, labels)
    assert good.columns == docs.columns and good.where("text LIKE 'a pl%'").count() == 100
    assert good.where("text LIKE 'scum%'").count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def test_classifiers_learn_from_long_texts_and_bounded_bytes(spark, monkeypatch):
    long = "filler words " * 200_000 + "at the end: scum"
    rows = [(0, long, "s"), (1, "b", "s"), (1, "a", "s"), (2, None, "s"), (None, "x", "s")] + [(i, "c" * 100, "s") for i in range(3, 103)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(103)] + [(1, None), (2, 1), (None, 1)], "doc_id long, toxic int")
    sample, share = common.labelled_sample(table(spark, rows), labels, "toxic", F.expr("doc_id <> 5"), 1000)
    got = sorted((r.text, r.y) for r in sample.collect())
    assert got == sorted([(long, 0), ("a", 1), ("", 1)] + [("c" * 100, i % 2) for i in range(3, 103) if i != 5])
    assert share == sum(y for _, y in got) / len(got)
    monkeypatch.setattr(common, "SAMPLE_BYTES", len(long) // 2)
    fewer = common.labelled_sample(table(spark, rows), labels, "toxic", F.expr("doc_id <> 5"), 1000)[0].collect()
    assert 25 <= len(fewer) <= 75
    few = common.labelled_sample(table(spark, rows), labels, "toxic", F.expr("doc_id <> 5"), 10)[0].groupBy("y").count().collect()
    assert all(2 <= r["count"] <= 25 for r in few) and len(few) == 2
    assert common.labelled_sample(table(spark, rows).limit(0), labels, "toxic", F.expr("true"), 1000)[0].count() == 0


def test_language_model_base_score(spark):
    docs = table(spark)
    got = {r.doc_id: r for r in lm.lm_scores(docs, fold("doc_id", 7) != 2).collect()}
    words = {i: (t or "").lower().split() + ["</s>"] for i, t, _ in ROWS}
    train = [w for i, t, _ in ROWS if (0 if i is None else zlib.crc32(str(i).encode()) % 7) != 2 for w in (t or "").lower().split() + ["</s>"]]
    n, v = len(train), len(set(train))
    for i, tokens in words.items():
        base = sum(np.log10((train.count(w) + 1) / (n + v + 1)) for w in set(tokens) for _ in range(tokens.count(w)))
        assert got[i].n_tokens == len(tokens) and got[i].train_tokens == n and abs(got[i].base_score - base) < 1e-6 * abs(base)
        assert got[i].n_known == sum(w in set(train) for w in tokens) and got[i].score < 0


def test_language_model_learns_from_every_position(spark):
    texts = ["c c" if i % 8 < 3 else "a b" for i in range(20480)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    hashes = dict(zip("abc", lm.word_hashes(b"a b c").tolist(), strict=False))
    counts = [(h, sum(t.split().count(w) for t in texts)) for w, h in hashes.items()] + [(lm.END_HASH, len(texts))]
    vocab = lm.Vocabulary(counts, sum(c for _, c in counts), len(counts))
    model = lm.trained(docs, vocab)
    a, b, c = vocab.look_up(np.array([hashes[w] for w in "abc"]))[0]
    after = lm.log_probabilities(np.array([b, c]), np.array([a, a]), np.array([vocab.size] * 2), model)
    assert after[0] > after[1]


def test_language_model_is_the_same_at_any_width(spark, monkeypatch):
    """Several copies and rounds: the score does not see partitions, and held-out texts gain by what was learned."""
    monkeypatch.setattr(lm, "COPY_TOKENS", 20_000)
    draw = np.random.default_rng(2)
    follow = {f"w{i}": [f"w{j}" for j in draw.integers(0, 40, 2)] for i in range(40)}

    def text():
        words = ["w0"]
        while len(words) < 60:
            words.append(follow[words[-1]][int(draw.integers(2))])
        return " ".join(words)

    docs = spark.createDataFrame([(i, text()) for i in range(1500)] + [(None, None), (7, "")], "doc_id long, text string")
    wide, narrow = (
        {r.doc_id: r for r in lm.lm_scores(docs.repartition(n), fold("doc_id", 7) != 2).where("doc_id <> 7").collect()} for n in (9, 1)
    )
    assert len(wide) == 1499 and all(abs(wide[i].score - narrow[i].score) < 1e-3 for i in wide)
    held = [r for i, r in wide.items() if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.lm_scores(docs, fold("doc_id", 7) > 99).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert lm.lm_scores(docs.limit(0), fold("doc_id", 7) != 2).count() == 0


def test_no_operator_leaves_a_session_setting_behind(spark):
    before = {k: spark.conf.get(k) for k in spark.conf.getAll}
    docs, path = table(spark), scratch_path(spark, "test-settings")
    token_files.write_token_files(docs, bpe.public_file("byte_bpe_50k.json"), 2, path)
    assert token_files.with_crc(token_files.read_token_files(spark, path)).count() == len(ROWS)
    assert bpe.tokenised(docs).count() == len(ROWS)
    assert {k: spark.conf.get(k) for k in spark.conf.getAll} == before


def test_tokens_and_files(spark):
    docs = table(spark)
    back = bpe.tokenised(docs).collect()
    assert len(back) == len(ROWS) and all(r.round_trip and r.n_tokens == len(r.ids) for r in back)
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(docs, bpe.public_file("byte_bpe_50k.json"), 2, path)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.ids[-1] == 2
        at += len(r.ids)
    assert hashlib.sha256 is not None
    # Digests taken where the ids are decoded are those of the ids.
    expected = sorted((r.start, r.doc_id is None, r.doc_id or 0, len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in got)
    for df in (token_files.read_token_files(spark, path, digest=True), token_files.with_crc(token_files.read_token_files(spark, path))):
        assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert sorted((r.start, r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in df.collect()) == expected


VECTORS = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(300)]
ODD = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 3), (1004, [None] * 8), (None, [1.0] * 8)]


def test_vectors(spark):
    copies = [(500 + i, VECTORS[0][1]) for i in range(5)] + [(600, [x * 2 for x in VECTORS[0][1]])]
    data = VECTORS + copies + ODD
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in forest.near_vectors(df).collect()}
    good = VECTORS + copies
    x = np.array([v for _, v in good], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert [got[i].n_links for i, _ in good] == links.tolist() and got[600].component_id == 0 and got[505 - 1].kept is False
    assert all(got[i].n_links == 0 and got[i].kept for i, _ in ODD)
    found = ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), 20).collect()
    assert {r.query_id for r in found} == {i for i, _ in good if i % 20 == 0}
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert all(len(v) == 20 and sorted(x.rank for x in v) == list(range(1, 21)) for v in by.values())
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0 and forest.near_vectors(df.limit(0)).count() == 0


def test_links_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 64))
    x[:3000] = x[0] + rng.normal(size=(3000, 64)) * np.linalg.norm(x[0]) * np.sqrt(0.031 / 64)
    x[3000:3600] = x[3000] + rng.normal(size=(600, 64)) * np.linalg.norm(x[3000]) * np.sqrt(0.05 / 64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in forest.near_vectors(df).collect()}
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum()


def test_sharding_sql_on_odd_rows(spark):
    con = duckdb.connect()
    documents = table(spark).select("doc_id", "text").toPandas()  # noqa: F841
    mine = sorted((str(r.doc_id), r.shard) for r in sharding.extendible_shards(table(spark), 100).collect())
    sql = sharding.OP1_SQL.replace(str(sharding.BYTE_LIMIT), "100").replace("row_number() OVER (PARTITION BY h, doc_id ORDER BY depth)", "rank() OVER (PARTITION BY h, doc_id ORDER BY depth)")
    theirs = sorted((str(None if r[0] != r[0] or r[0] is None else int(r[0])), r[1]) for r in con.execute(f"SELECT doc_id, shard FROM ({sql.replace('FROM documents', 'FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents)')})").fetchall())
    assert mine == theirs
