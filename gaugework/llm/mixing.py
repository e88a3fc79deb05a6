"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import documents, fresh, hex_uniform, settled

# A rate above this is drawn as a sum of that many smaller ones, as exp(-rate) would vanish.
PART = 64.0


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, size: float = 1.0):
    """Mean repetitions per source: (_source, n_docs, rate).

    The target share of a source is its given weight, or its number of documents to the
    power ``alpha``; the expected size of the mixture is ``size`` times the documents.
    A null source is a source of its own. A source without a given weight gets none.
    """
    counts = docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        wanted = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    else:
        wanted = F.lit(0.0)
        for name, weight in weights.items():
            wanted = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(wanted)
    counts = counts.withColumn("_wanted", wanted)
    totals = counts.agg(F.sum("_wanted").alias("w"), F.sum("n_docs").alias("n")).first()
    docs_in, all_wanted = float(totals["n"] or 0), float(totals["w"] or 0.0) or 1.0
    rate = F.lit(size * docs_in) * (F.col("_wanted") / F.lit(all_wanted)) / F.col("n_docs")
    return counts.select("_source", "n_docs", rate.alias("rate"))


def with_cdf(rates: DataFrame) -> DataFrame:
    """Add ``parts`` and the cumulative Poisson probabilities of one part."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    r = F.col("_part_rate")
    length = (F.ceil(r + 12 * F.sqrt(r)) + 30).cast("int")

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * r / k
        total = F.element_at(state["cdf"], -1) + term
        return F.struct(term.alias("term"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    start = F.struct(F.exp(-r).alias("term"), F.array(F.exp(-r)).alias("cdf"))
    table = rates.withColumn("parts", parts).withColumn("_part_rate", F.col("rate") / F.col("parts"))
    numbers = F.transform(F.sequence(F.lit(1), length), lambda k: k.cast("double"))
    return table.withColumn("_cdf", F.aggregate(numbers, start, step, lambda s: s["cdf"])).drop("_part_rate")


def poisson_mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, size: float = 1.0, seed: int = 7
) -> DataFrame:
    """All columns of ``docs``, each row repeated by its Poisson count, in a global random order.

    Added columns: ``copy`` (from 1), ``n_copies``, ``rate`` and ``shuffle_key``. The uniform
    behind a count is a hash of seed and id (of the text where the id is null), so a rerun
    draws the same; identical rows get the same count. Rows are dealt to partitions by a
    hash of the shuffle key and sorted by it inside. An added name that ``docs`` has
    already gets underscores. An empty table stays empty.
    """
    spark = docs.sparkSession
    table = settled(spark, with_cdf(source_rates(docs, weights, alpha, size)))
    copy, n_copies, rate, place = (fresh(docs, c) for c in ("copy", "n_copies", "rate", "shuffle_key"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    draw = lambda j: hex_uniform(F.concat_ws("|", F.lit(f"mix{seed}"), key, j.cast("string")))
    one = lambda j: F.size(F.filter("_cdf", lambda c: c <= draw(j)))
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), one), F.lit(0), lambda a, b: a + b)
    joined = docs.join(table.withColumnRenamed("rate", "_rate"), docs["source"].eqNullSafe(table["_source"]))
    counted = joined.withColumn(n_copies, count).where(F.col(n_copies) > 0)
    repeated = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    shuffled = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"place{seed}"), key, F.col(copy).cast("string"))), 1, 15), 16, 10)
    out = repeated.withColumn(place, shuffled.cast("long")).withColumn(rate, F.col("_rate"))
    out = out.select(*docs.columns, copy, n_copies, rate, place)
    return out.repartition(F.col(place)).sortWithinPartitions(place)


def op8_mixing(spark, sf_dir):
    mixed = poisson_mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "text", "copy", "n_copies", F.round("rate", 9).alias("rate"), "shuffle_key")


OP8_SQL = f"""
WITH RECURSIVE counted AS (
  SELECT source, count(*) AS n_docs, pow(count(*)::DOUBLE, 0.5) AS wanted FROM documents GROUP BY source
), rates AS (
  SELECT source, (SELECT sum(n_docs)::DOUBLE FROM counted) * (wanted / (SELECT sum(wanted) FROM counted)) / n_docs AS rate
  FROM counted
), parted AS (
  SELECT *, greatest(1, ceil(rate / {PART}))::INT AS parts FROM rates
), lengths AS (
  SELECT *, rate / parts AS r, (ceil(rate / parts + 12 * sqrt(rate / parts)) + 30)::INT AS most FROM parted
), cdf AS (
  SELECT source, 0 AS k, exp(-r) AS term, exp(-r) AS total FROM lengths
  UNION ALL
  SELECT c.source, c.k + 1, c.term * l.r / (c.k + 1)::DOUBLE, c.total + c.term * l.r / (c.k + 1)::DOUBLE
  FROM cdf c JOIN lengths l ON c.source IS NOT DISTINCT FROM l.source WHERE c.k < l.most
), keyed AS (
  SELECT d.doc_id, d.source, d.text, p.rate, p.parts, coalesce(d.doc_id::VARCHAR, md5(d.text), '') AS key
  FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source
), draws AS (
  SELECT doc_id, source, key,
         ('0x' || substr(md5(concat_ws('|', 'mix7', key, j::VARCHAR)), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)} AS u
  FROM keyed, LATERAL (SELECT unnest(range(1, parts + 1)) AS j)
), counts AS (
  SELECT w.doc_id, w.source, w.key, count(*)::INT AS n_copies
  FROM draws w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.total <= w.u GROUP BY ALL
)
SELECT k.doc_id, k.source, k.text, i::INT AS copy, n_copies, round(rate, 9) AS rate,
       ('0x' || substr(md5(concat_ws('|', 'place7', k.key, i::VARCHAR)), 1, 15))::BIGINT AS shuffle_key
FROM keyed k JOIN counts n ON k.key = n.key AND k.source IS NOT DISTINCT FROM n.source,
     LATERAL (SELECT unnest(range(1, n_copies + 1)) AS i)
"""
