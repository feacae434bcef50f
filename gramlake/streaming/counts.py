"""Incremental counts: merging models is addition, so a stream keeps a model up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.ngrams import char_grams, chars


def char_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """For output mode ``complete`` or ``update``."""
    return stream.select(F.explode(chars(F.col(text))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def sparse_counts(stream: DataFrame, block: int, text: str = "text") -> DataFrame:
    """Sparse ``k, prefix, successor, n`` of all texts so far; densify what is read back."""
    grams = stream.where(F.length(text) > block).select(F.explode(char_grams(F.col(text), block)).alias("gram"))
    rows = grams.select((F.length("gram") - 1).alias("k"), F.expr("substring(gram, 1, length(gram) - 1)").alias("prefix"), F.expr("right(gram, 1)").alias("successor"))
    return rows.groupBy("k", "prefix", "successor").agg(F.count("*").alias("n"))


def windowed_transitions(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event types per window of time, late rows dropped after the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
