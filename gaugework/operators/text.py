"""Word and word-pair frequencies of a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.joins import one_row
from gaugework.session import cut_lineage, settle

# A word is a letter, digit or underscore followed by more of them or apostrophes.
# Runs of plain letters are taken by the quicker class, and nothing is tried again.
WORD = r"[\p{L}\p{N}_][a-z0-9_']*+(?:[\p{L}\p{N}_'][a-z0-9_']*+)*+"

# Common English words that say nothing about a text.
STOP_WORDS = (
    "a about above after again against all also am an and any are aren't as at be because been before "
    "being below between both but by can can't cannot com could couldn't did didn't do does doesn't doing "
    "don't down during each else ever few for from further get had hadn't has hasn't have haven't having he "
    "he'd he'll he's hence her here here's hers herself him himself his how how's however http i i'd i'll "
    "i'm i've if in into is isn't it it's its itself just k let's like me more most mustn't my myself no nor "
    "not of off on once only or other otherwise ought our ours ourselves out over own r same shall shan't she "
    "she'd she'll she's should shouldn't since so some such than that that's the their theirs them themselves "
    "then there there's therefore these they they'd they'll they're they've this those through to too under "
    "until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's "
    "which while who who's whom why why's with won't would wouldn't www you you'd you'll you're you've your "
    "yours yourself yourselves"
).split()


def words_of(text: str | Column) -> Column:
    """Words in order, lower case, without a trailing 's and without plain numbers."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    bare = F.transform(found, lambda w: F.when(w.endswith("'s"), F.left(w, F.length(w) - 2)).otherwise(w))
    return F.filter(bare, lambda w: w.between("a", "{") | ~w.rlike(r"^\p{Nd}+$"))


def token_counts(
    df: DataFrame,
    text: str,
    stopwords: Sequence[str] = tuple(STOP_WORDS),
    merge_plurals: bool = False,
) -> DataFrame:
    """Frequency of every word that is not a stop word.

    ``merge_plurals`` adds the count of ``words`` to ``word`` when both occur.
    """
    # The outer form keeps Catalyst from splitting every text twice to test for empty lists.
    words = df.select(F.explode_outer(words_of(text)).alias("word")).where(F.col("word").isNotNull())
    counts = words.where(~F.col("word").isin(*stopwords)).groupBy("word").agg(F.count("*").alias("n"))
    if not merge_plurals:
        return counts
    merged = counts.groupBy(singular("word").alias("base")).agg(F.sum("n").alias("n"), F.min("word").alias("word"))
    return merged.select("word", "n")


def singular(word: str) -> Column:
    """A word without its plural s.

    A word ends in one s at most to count as a plural, so it is never a singular as
    well: words of one singular are a word, its plural, or both.
    """
    plural = F.col(word).endswith("s") & ~F.col(word).endswith("ss") & (F.length(word) > 1)
    return F.when(plural, F.left(F.col(word), F.length(word) - 1)).otherwise(F.col(word))


def merge_plurals_of(neighbours: DataFrame) -> DataFrame:
    """Neighbour counts with every plural, on either side, counted as its singular where that occurs too.

    Every word of ``neighbours`` stands first somewhere. The plural map has one row per plural that has a singular;
    pairs that become alike are added up.
    """
    words = neighbours.select(F.col("first").alias("word")).distinct()
    pairs = words.groupBy(singular("word").alias("to")).agg(F.max("word").alias("word"), F.count("*").alias("forms"))
    plurals = settle(pairs.where("forms > 1").select("word", "to"))
    out = neighbours
    for side in ("first", "second"):
        named = plurals.select(F.col("word").alias(side), F.col("to").alias("to"))
        out = out.join(named, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return _per_pair(out, F.sum("n"))


def _per_pair(pairs: DataFrame, n: Column) -> DataFrame:
    """``n`` of every (first, second), written to the shared folder.

    Words hold no blanks, so a pair is one key while it is counted: the table of all pairs is what
    takes the time, and it is half as large that way.
    """
    grouped = pairs.groupBy(F.concat_ws(" ", "first", "second").alias("pair")).agg(n.alias("n"))
    words = F.split("pair", " ")
    return cut_lineage(grouped.select(words[0].alias("first"), F.get(words, F.lit(1)).alias("second"), "n"), "neighbours")


def neighbour_counts(df: DataFrame, text: str, stopwords: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Frequency of every word (no stop words) together with the word after it.

    The follower is null at the end of a row and where it is a stop word. Both word and
    pair frequencies are sums over this table. It is written to the shared folder, so
    that the texts are split only once.
    """
    words = df.select(words_of(text).alias("words"))
    following = F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(0)))
    pairs = words.select(F.inline_outer(F.arrays_zip(F.col("words").alias("first"), following.alias("second"))))
    pairs = pairs.where(F.col("first").isNotNull() & ~F.col("first").isin(*stopwords))
    pairs = pairs.withColumn("second", F.when(~F.col("second").isin(*stopwords), F.col("second")))
    return _per_pair(pairs, F.count("*"))


def _log_likelihood(k: Column, n: Column, share: str) -> Column:
    return F.col(f"yes{share}") * k + F.col(f"no{share}") * (n - k)


def collocations(
    df: DataFrame,
    text: str,
    stopwords: Sequence[str] = tuple(STOP_WORDS),
    threshold: float = 30.0,
) -> DataFrame:
    """Neighbouring word pairs whose log-likelihood ratio (Dunning) exceeds ``threshold``."""
    pairs, unigrams = _pairs_and_words(neighbour_counts(df, text, stopwords))
    return _scored(pairs, unigrams, threshold)


def _pairs_and_words(neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pair counts, and the counts of the single words, written to the shared folder."""
    words = cut_lineage(neighbours.groupBy(F.col("first").alias("word")).agg(F.sum("n").alias("n")), "words")
    return neighbours.where(F.col("second").isNotNull()), words


def _scored(pairs: DataFrame, unigrams: DataFrame, threshold: float) -> DataFrame:
    """The pairs above ``threshold``, written to the shared folder, so that they are scored only once."""
    total = one_row(unigrams.agg(F.sum("n").alias("total")))["total"]
    firsts = unigrams.select(F.col("word").alias("first"), F.col("n").alias("n_first"))
    seconds = unigrams.select(F.col("word").alias("second"), F.col("n").alias("n_second"))
    pairs = pairs.join(firsts, "first").join(seconds, "second")
    pairs = pairs.withColumn("total", total.cast("double"))
    both, c1, c2, size = F.col("n").cast("double"), F.col("n_first"), F.col("n_second"), F.col("total")
    shares = {"": ratio_of(c2, size), "1": ratio_of(both, c1), "2": ratio_of(c2 - both, size - c1)}
    floor = F.lit(1e-10)
    logs = {f"yes{i}": F.ln(F.greatest(p, floor)) for i, p in shares.items()}
    logs |= {f"no{i}": F.ln(F.greatest(1 - p, floor)) for i, p in shares.items()}
    independent = _log_likelihood(both, c1, "") + _log_likelihood(c2 - both, size - c1, "")
    dependent = _log_likelihood(both, c1, "1") + _log_likelihood(c2 - both, size - c1, "2")
    usable = (size > c1) & (size > c2)
    score = F.when(usable, -2 * (independent - dependent)).otherwise(0.0)
    # As a generator's output the score is not put into the filter a second time, with all its logarithms.
    scored = pairs.withColumns(logs).select("first", "second", "n", F.explode(F.array(score)).alias("score"))
    return cut_lineage(scored.where(F.col("score") > threshold), "collocations")


def ratio_of(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def phrase_counts(
    df: DataFrame,
    text: str,
    stopwords: Sequence[str] = tuple(STOP_WORDS),
    threshold: float = 30.0,
    merge_plurals: bool = False,
) -> DataFrame:
    """Words and collocations together: a word inside a collocation is not counted twice.

    With ``merge_plurals`` a plural counts as its singular where both occur, in words and
    at both ends of pairs, before pairs are scored.
    """
    neighbours = neighbour_counts(df, text, stopwords)
    candidates, words = _pairs_and_words(merge_plurals_of(neighbours) if merge_plurals else neighbours)
    pairs = _scored(candidates, words, threshold)
    used = pairs.select(F.explode(F.array("first", "second")).alias("word"), (-F.col("n")).alias("n"))
    singles = words.unionByName(used)
    singles = singles.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    phrases = pairs.select(F.concat_ws(" ", "first", "second").alias("word"), "n")
    return singles.unionByName(phrases)
