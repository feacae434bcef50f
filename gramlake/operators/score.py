"""Matching, longest-suffix search, probabilities and perplexity against a model.

Every lookup explodes the few suffixes of a query prefix and joins them to the
model by equality, so it is a hash join however large both sides are.  Queries
are reduced to distinct prefixes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.model import contexts
from gramlake.operators.ngrams import char_grams, spread, token_events
from gramlake.operators.prefixes import prefixes
from gramlake.sources.scratch import written

#: Stands in for a probability of zero under the logarithm.
TINY = 1e-8


def windows(docs: DataFrame, block: int, by: tuple[str, ...], text: str = "text") -> DataFrame:
    """``by..., prefix, successor, times``: all full windows of a text, the last token included."""
    rows = spread(docs.where(F.length(text) > block)).select(*by, F.explode(char_grams(F.col(text), block, include_start=False, include_last=True)).alias("gram"))
    rows = rows.groupBy(*by, "gram").agg(F.count("*").alias("times"))
    return rows.select(*by, F.expr("substring(gram, 1, length(gram) - 1)").alias("prefix"), F.expr("right(gram, 1)").alias("successor"), "times")


def token_windows(tokens: DataFrame, block: int, by: tuple[str, ...], column: str = "tokens") -> DataFrame:
    """As ``windows`` for token arrays."""
    rows = token_events(tokens, block, by, column, include_start=False, include_last=True)
    return rows.groupBy(*by, "prefix", "successor").agg(F.count("*").alias("times"))


def matches(queries: DataFrame, model: DataFrame) -> DataFrame:
    """Queries (``prefix``) whose whole prefix is in the model; the empty prefix never matches."""
    known = model.where("k > 0").select("prefix").distinct()
    return queries.where(prefixes(queries).size("prefix") > 0).join(known, "prefix", "left_semi")


def misses(queries: DataFrame, model: DataFrame) -> DataFrame:
    known = model.where("k > 0").select("prefix").distinct()
    return queries.join(known, "prefix", "left_anti")


def _suffixes(queries: DataFrame) -> DataFrame:
    """Each query once per suffix of its prefix, the empty one too: adds ``k, match``."""
    kind = prefixes(queries)
    rows = queries.select("*", F.explode(F.sequence(F.lit(0), kind.size("prefix"))).alias("k"))
    return rows.withColumn("match", kind.last("prefix", "k"))


def longest_suffix(prefixes: DataFrame, model: DataFrame) -> DataFrame:
    """Distinct ``prefix`` -> ``match, match_length, total``: the longest suffix in the model.

    The empty suffix matches whenever the model has any row at all.
    """
    distinct = prefixes.select("prefix").distinct()
    known = contexts(model).select(F.col("prefix").alias("match"), "total")
    found = _suffixes(distinct).join(known, "match").groupBy("prefix").agg(F.max(F.struct("k", "match", "total")).alias("m"))
    return found.select("prefix", "m.match", F.col("m.k").alias("match_length"), "m.total")


def probabilities(queries: DataFrame, model: DataFrame, back_off_at_zero: bool = True) -> DataFrame:
    """Adds ``match_length`` and ``probability`` of ``successor`` at the longest known suffix.

    With ``back_off_at_zero`` a successor that the longest suffix never had
    gets its unigram probability; without, zero.
    """
    found = longest_suffix(queries, model)
    counts = model.select(F.col("prefix").alias("match"), "successor", "n")
    unigram = model.where("k = 0").select("successor", F.col("n").alias("uni"))
    all_ = model.where("k = 0").agg(F.sum("n").alias("everything"))
    rows = queries.join(found, "prefix", "left").join(counts, ["match", "successor"], "left").join(unigram, "successor", "left").crossJoin(F.broadcast(all_))
    own = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    if back_off_at_zero:
        own = F.when(own > 0, own).otherwise(F.coalesce(F.col("uni") / F.col("everything"), F.lit(0.0)))
    return rows.select(*queries.columns, F.coalesce("match_length", F.lit(0)).alias("match_length"), own.alias("probability"))


def recursive_probabilities(queries: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``match_length`` and ``probability`` at the longest suffix that ``successor`` ever followed.

    Unlike ``probabilities`` this backs off one token at a time until the
    successor is found; one that is nowhere has probability 0 (length 0).
    """
    distinct = queries.select("prefix", "successor").distinct()
    known = model.join(contexts(model).select("k", "prefix", "total"), ["k", "prefix"])
    known = known.select(F.col("prefix").alias("match"), "successor", (F.col("n") / F.col("total")).alias("p"))
    best = _suffixes(distinct).join(known, ["match", "successor"]).groupBy("prefix", "successor").agg(F.max(F.struct("k", "p")).alias("m"))
    rows = queries.join(best, ["prefix", "successor"], "left")
    return rows.select(*queries.columns, F.coalesce("m.k", F.lit(0)).alias("match_length"), F.coalesce("m.p", F.lit(0.0)).alias("probability"))


def perplexity(docs: DataFrame, model: DataFrame, block: int, by: tuple[str, ...], text: str = "text") -> DataFrame:
    """``by..., windows, lg_pp, perplexity, lg_squared`` of each text (or array of tokens).

    lg_pp is the mean of -log2 of the probabilities of all full windows
    (zero counts as TINY); the perplexity is 2 ** lg_pp.
    """
    cut = token_windows if prefixes(model).tokens else windows
    # written once: contexts, counts and unigrams all come from the same counts
    rows = probabilities(cut(docs, block, by, text), written(model, "perplexity-model"))
    bits = -F.log2(F.when(F.col("probability") > 0, F.col("probability")).otherwise(F.lit(TINY)))
    per = rows.groupBy(*by).agg(F.sum("times").alias("windows"), (F.sum(bits * F.col("times")) / F.sum("times")).alias("lg_pp"))
    return per.withColumn("perplexity", F.pow(F.lit(2.0), "lg_pp")).withColumn("lg_squared", F.col("lg_pp") * F.col("lg_pp"))
