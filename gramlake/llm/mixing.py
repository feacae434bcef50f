"""Mixing sources to target weights with hash-threshold histograms; built-in functions only.

Every document gets a hash of 3 * 10 bits from its doc_id and text.  A source that is
to give r times its words takes floor(r) copies of each document and one more
of those whose hash lies below a threshold.  The threshold comes from sums of
words by source and hash bucket: the bucket in which the running sum passes
the budget is the only one that is looked into more finely, twice, and the
documents are then filtered by comparison.  Nothing sorts documents, and a
larger budget only raises the threshold, so mixes of growing budgets nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import free_name, written

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Words that the mix holds, and most of a source, as multiples of what there is.
SHARE, MOST = 1.5, 2.0
LEVELS, BITS = 3, 10


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 30 bits of the MD5 of ``doc_id:text`` (null: nothing), so rows without ids, or that share one, spread too."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.shiftright(F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long"), 2)


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` -> with ``target``: shares by weight under the caps.

    Sources are ordered by cap per weight; the share per weight unit of those
    not capped is what remains of the total over the weights that remain.  It
    rises while capping a source frees words for the others and falls after,
    so its largest value is where repeated resharing of the excess ends.  One
    row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * MOST)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * SHARE)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    until, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    unit = (F.col("total") - F.coalesce(F.sum("cap").over(until), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("unit", unit)
    rows = rows.withColumn("level", F.max("unit").over(everything))
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def thresholds(light: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source -> cut``: hashes below it make the source's words come nearest its budget.

    ``light`` has ``source, size, h``; ``budgets`` has ``source, budget``.
    """
    open_ = budgets.select("source", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("before"), F.col("budget").cast("double"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift)
        rows = light.select(F.col("source").alias("s"), "size", "h", bucket.alias("bucket"))
        bounds = open_.select(F.col("source"), "start", "before", "budget")
        inside = F.col("s").eqNullSafe(F.col("source"))
        if level:
            inside = inside & (F.shiftright("h", shift + BITS) == F.shiftright("start", shift + BITS))
        sums = rows.join(bounds, inside).groupBy("source", "start", "before", "budget", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(run))
        # the first bucket that passes the budget; if none does, the last
        hit = sums.withColumn("passes", F.col("upto") > F.col("budget"))
        picked = hit.groupBy("source", "budget").agg(
            F.min(F.when(F.col("passes"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), F.col("upto")))).alias("pass"),
            F.max(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), F.col("upto"))).alias("end"),
        ).withColumn("at", F.coalesce("pass", "end"))
        open_ = written(picked.select("source", F.shiftleft("at.bucket", shift).alias("start"), F.col("at.below").alias("before"), "budget", F.col("at.upto").alias("upto")), "mix-level")
    nearer = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("before")
    return open_.select("source", F.when(nearer, F.col("start") + 1).otherwise(F.col("start")).alias("cut"))


def _light(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h"))


def plan_mix(light: DataFrame) -> DataFrame:
    """One row per source: ``plan_source, source_size, target, whole, cut``."""
    plan = written(targets(light.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio))
    cuts = thresholds(light, plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    cuts = cuts.select(F.col("source").alias("cut_source"), "cut")
    both = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")))
    return written(both.select(F.col("source").alias("plan_source"), "source_size", "target", "whole", "cut"), "mix-plan")


def copies(h: Column) -> Column:
    """How often a document of hash ``h`` is taken under its source's plan."""
    return (F.col("whole") + F.when((h < F.col("cut")) & (F.col("whole") < MOST), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row.

    A null text has no words, a null source is a source of its own (last), and
    rows with equal doc_id and text share their hash and so their fate.  A source
    without words gets target 0.  An empty table gives an empty result; other
    columns are ignored.
    """
    light = written(_light(docs), "mix-light")
    plan = plan_mix(light)
    out = light.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("copies", copies(F.col("h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns kept.

    Cases are those of ``mix``; only the plan (a row per source) meets the texts.
    """
    source, plan, copy = (free_name(docs, "__mix_" + x) for x in ("source", "plan", "copy"))
    found = plan_mix(written(_light(docs), "mix-light")).select(F.col("plan_source").alias(source), F.struct("whole", "cut").alias(plan))
    own = docs.join(found, docs.source.cast("string").eqNullSafe(F.col(source)))
    extra = (document_hash(docs.doc_id, docs.text) < F.col(plan)["cut"]) & (F.col(plan)["whole"] < MOST)
    times = (F.col(plan)["whole"] + F.when(extra, 1).otherwise(0)).cast("int")
    return own.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), times)).alias(copy)).drop(copy)


def op5_query(docs: DataFrame) -> DataFrame:
    """What the mix takes of every row of ``documents``; cases are those of ``mix``."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
