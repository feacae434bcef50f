"""Algebra and statistics of the ``node(k, prefix, successor, n)`` relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.prefixes import prefixes

KEY = ["k", "prefix", "successor"]


def merge(*models: DataFrame) -> DataFrame:
    """Sum of counts; associative and commutative."""
    return reduce(DataFrame.unionByName, models).groupBy(*KEY).agg(F.sum("n").alias("n"))


def reduce_counts(model: DataFrame, other: DataFrame, on: list[str] = KEY) -> DataFrame:
    """Take the other's counts away where there are as many; undoes ``merge``."""
    rows = model.join(other.select(*on, F.col("n").alias("m")), on, "left")
    return rows.select(*on, F.when(F.col("n") >= F.coalesce("m", F.lit(0)), F.col("n") - F.coalesce("m", F.lit(0))).otherwise(F.col("n")).alias("n"))


def add_event(model: DataFrame, prefix, successor, dense: bool = True, n: int = 1) -> DataFrame:
    """The model after ``n`` more events of one prefix (all its suffixes if dense) and successor."""
    kind = prefixes(model)
    if not len(prefix):
        raise ValueError("the prefix must not be empty")
    cuts = range(len(prefix) + 1) if dense else (len(prefix),)
    rows = [(k, kind.cut(prefix, k) if k else prefix[:0], successor, n) for k in cuts]
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in (("k", model.schema["k"].dataType), ("prefix", kind.type), ("successor", model.schema["successor"].dataType), ("n", model.schema["n"].dataType)))
    return merge(model.select(*KEY, "n"), model.sparkSession.createDataFrame(rows, schema))


def remove_count(model: DataFrame, prefix, successor, n: int) -> DataFrame:
    """Take ``n`` away from one entry if it has as many."""
    own = F.lit(prefix) if isinstance(prefix, str) else F.array(*map(F.lit, prefix)).cast(prefixes(model).type)
    hit = (F.col("prefix") == own) & (F.col("successor") == successor) & (F.col("n") >= n)
    return model.withColumn("n", F.when(hit, F.col("n") - n).otherwise(F.col("n")))


def clean(model: DataFrame) -> DataFrame:
    return model.where("n > 0")


def histogram(model: DataFrame) -> DataFrame:
    """Adds ``total`` of the prefix and ``probability`` of the successor."""
    total = F.sum("n").over(Window.partitionBy("k", "prefix"))
    return model.withColumn("total", total).withColumn("probability", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def contexts(model: DataFrame) -> DataFrame:
    """One row per prefix: ``k, prefix, total, choices``."""
    return model.groupBy("k", "prefix").agg(F.sum("n").alias("total"), F.count("*").alias("choices"))


def verify(model: DataFrame) -> DataFrame:
    """Prefixes whose entries are not all positive, or that no shorter prefix accounts for.

    In a dense model the counts of (prefix, successor) are at least those of
    all its one-longer prefixes together.
    """
    longer = model.where("k > 0").groupBy((F.col("k") - 1).alias("k"), prefixes(model).rest("prefix").alias("prefix"), "successor").agg(F.sum("n").alias("m"))
    rows = longer.join(model, KEY, "left")
    return rows.where("n is null or n <= 0 or m > n").select(*KEY, "n", "m")


def leaves(model: DataFrame) -> DataFrame:
    """Rows of prefixes that no longer prefix ends in (k >= 1)."""
    inner = model.where("k > 1").select((F.col("k") - 1).alias("k"), prefixes(model).rest("prefix").alias("prefix")).distinct()
    return model.where("k >= 1").join(inner, ["k", "prefix"], "left_anti")


def sizes(model: DataFrame) -> DataFrame:
    """One row: ``prefixes, patterns, occurrences`` over the leaves."""
    per = leaves(model).groupBy("k", "prefix").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return per.agg(F.count("*").alias("prefixes"), F.coalesce(F.sum("c"), F.lit(0)).alias("patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))


def depth(model: DataFrame) -> DataFrame:
    return model.agg(F.max("k").alias("depth"))


def memory(model: DataFrame) -> DataFrame:
    """Size estimate in bytes: a sampler takes 8 and 6 per entry, a node 2 more."""
    per = contexts(model)
    return per.agg(F.sum(8 + 6 * F.col("choices") + F.when(F.col("k") > 0, 2).otherwise(0)).alias("bytes"))


def size(model: DataFrame) -> DataFrame:
    """One row: ``size``, the root tokens that the model has parts for."""
    return model.where("k > 0").select(prefixes(model).root("prefix").alias("root")).agg(F.count_distinct("root").alias("size"))


def children(model: DataFrame, prefix=None) -> DataFrame:
    """``token, prefix, total, choices`` of the prefixes one token longer than ``prefix``; of the roots without one."""
    kind = prefixes(model)
    n = 0 if prefix is None else len(prefix)
    rows = contexts(model.where(F.col("k") == n + 1))
    if n:
        own = F.lit(prefix) if not kind.tokens else F.array(*map(F.lit, prefix)).cast(kind.type)
        rows = rows.where(kind.rest("prefix") == own)
    first = F.expr("element_at(prefix, 1)" if kind.tokens else "left(prefix, 1)")
    return rows.select(first.alias("token"), "prefix", "total", "choices")


def by_root(model: DataFrame) -> DataFrame:
    """Per root token: prefixes, patterns, occurrences of its part of the model."""
    rows = model.where("k > 0").withColumn("root", prefixes(model).root("prefix"))
    per = rows.groupBy("root", "k", "prefix").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return per.groupBy("root").agg(F.count("*").alias("prefixes"), F.sum("c").alias("patterns"), F.sum("n").alias("occurrences"))


def cdf(model: DataFrame) -> DataFrame:
    """Adds ``lo, hi`` (cumulative counts by code point of the successor) and ``total``."""
    by = Window.partitionBy("k", "prefix")
    run = by.orderBy("successor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.sum("n").over(run)
    return model.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("n")).withColumn("total", F.sum("n").over(by))


def most_likely(model: DataFrame) -> DataFrame:
    """``k, prefix, successor, n`` of the commonest successor, the smallest among equals."""
    best = F.min(F.struct((-F.col("n")).alias("m"), "successor", "n")).alias("best")
    return model.groupBy("k", "prefix").agg(best).select("k", "prefix", "best.successor", "best.n")


def top_successors(model: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("k", "prefix").orderBy(F.col("n").desc(), "successor")
    return model.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def subtree(model: DataFrame, token) -> DataFrame:
    """The part of the model under one root token, a JSON object per prefix."""
    rows = model.where((F.col("k") > 0) & (prefixes(model).root("prefix") == token)).withColumn("successor", F.col("successor").cast("string"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("successor", "n"))))
    per = rows.groupBy("k", "prefix").agg(counts.alias("counts"), F.sum("n").alias("total"))
    return per.select("prefix", F.to_json(F.struct("k", "prefix", "total", "counts")).alias("json"))
