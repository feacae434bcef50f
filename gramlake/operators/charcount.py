"""Character counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.ngrams import chars, spread


def char_counts(rows: DataFrame, text: str = "text", exclude: tuple[str, ...] = ()) -> DataFrame:
    """``char, n`` over all texts; null counts as empty.

    Counting is partial before the shuffle, so each task sends a row per
    distinct character it has met.
    """
    each = spread(rows.select(text)).select(F.explode(chars(F.coalesce(F.col(text), F.lit("")))).alias("char"))
    counts = (each.where(~F.col("char").isin(*exclude)) if exclude else each).groupBy("char")
    return counts.agg(F.count("*").alias("n"))


def char_counts_of_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """As ``char_counts`` of the lines of the texts, each line adding one line feed."""
    lines = docs.select(F.explode(F.split(text, "\n", -1)).alias("line"))
    ends = lines.agg(F.count("*").alias("n")).select(F.lit("\n").alias("char"), "n")
    return char_counts(lines, "line").union(ends.where("n > 0"))
