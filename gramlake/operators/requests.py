"""The service's verbs over tables: every row is a request, and every request has a row of answer.

``operators.service`` answers one request at a time; these answer as many as a
table holds, without bringing requests, alphabet or answers to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions import language
from gramlake.operators import model as algebra
from gramlake.operators import sample
from gramlake.operators.ngrams import chars
from gramlake.operators.service import MAX_BATCH, MAX_BATCHES, MAX_PROMPT_BYTES, MAX_PROMPT_CHARS, MAX_SAMPLES
from gramlake.sources.scratch import written


def valid_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text``: what the language of a corpus of characters accepts."""
    return language.char_language(docs, text).select(F.col("piece").alias("text"))


def are_valid(requests: DataFrame, valid: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, valid``: whether all characters of a text are among ``valid`` (``text``); the empty text is valid, a null one null."""
    used = requests.select(key, text, F.explode_outer(F.array_distinct(chars(F.col(text)))).alias("__char"))
    known = valid.select(F.col("text").alias("__char"), F.lit(1).alias("__known"))
    # keys may repeat, so texts are part of the key by their hash
    rows = used.select(key, F.sha2(text, 256).alias("__text"), "__char").distinct().join(known, "__char", "left")
    found = rows.groupBy(key, "__text").agg((F.count("__char") == F.count("__known")).alias("valid"))
    return found.select(key, F.when(F.col("__text").isNotNull(), F.col("valid")).alias("valid"))


def block_size(model: DataFrame) -> DataFrame:
    return algebra.depth(model).select(F.coalesce("depth", F.lit(0)).alias("size"))


def refused(text: Column, samples: int, batch: int, batches: int = 1) -> Column:
    """Why a request is refused, or null."""
    if not 1 <= samples <= MAX_SAMPLES or not 1 <= batch <= MAX_BATCH or not 0 <= batches <= MAX_BATCHES:
        raise ValueError("samples or batches are out of their bounds")
    return F.when(text.isNull(), "no prompt").when((F.length(text) > MAX_PROMPT_CHARS) | (F.octet_length(text) > MAX_PROMPT_BYTES), "the prompt is too long")


def generate_batches(requests: DataFrame, model: DataFrame, block: int, batch: int, samples: int = 1) -> DataFrame:
    """``request, draw, text, error``: of every request (``request, text``) ``samples`` texts of ``batch`` more characters.

    A request's draws are seeded by its number times MAX_SAMPLES and the draw.
    Requests that are refused have one row, with the reason.
    """
    asked = requests.select(F.col("request").cast("long").alias("request"), "text").withColumn("error", refused(F.col("text"), samples, batch))
    good = asked.where("error is null").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    prompts = good.select((F.col("request") * MAX_SAMPLES + F.col("draw")).alias("sample"), "text")
    made = sample.generate(prompts, model, batch, block)
    seed = F.col("sample")
    out = made.select(F.floor(seed / MAX_SAMPLES).cast("long").alias("request"), F.pmod(seed, F.lit(MAX_SAMPLES)).cast("int").alias("draw"), "text", F.lit(None).cast("string").alias("error"))
    bad = asked.where("error is not null").select("request", F.lit(0).alias("draw"), F.lit(None).cast("string").alias("text"), "error")
    return out.unionByName(bad)


def generate_streams(requests: DataFrame, model: DataFrame, block: int, batch: int, batches: int) -> DataFrame:
    """``request, batch, text``: of every request ``batches`` chunks, each going on from the last characters of the one before.

    Chunk n is drawn under the request's number plus n.  Chunks of all requests
    are drawn together, one after the other.
    """
    now = requests.select(F.col("request").cast("long").alias("request"), "text").where(refused(F.col("text"), 1, batch, batches).isNull())
    tail = lambda text: F.expr(f"right({text}, {block})")
    now = written(now.select("request", tail("text").alias("text")), "streams")
    model, parts = written(model, "streams-model"), []
    for n in range(batches):
        drawn = sample.generate(now.select((F.col("request") + n).alias("sample"), "text"), model, batch, block)
        drawn = drawn.select((F.col("sample") - n).alias("request"), F.col("text").alias("whole"))
        drawn = written(now.join(drawn, "request").select("request", F.lit(n).alias("batch"), F.expr("substring(whole, length(text) + 1)").alias("text"), "whole"), "streams-chunk")
        parts.append(drawn.select("request", "batch", "text"))
        now = drawn.select("request", tail("whole").alias("text"))
    empty = requests.sparkSession.createDataFrame([], "request long, batch int, text string")
    for part in parts:
        empty = empty.unionByName(part)
    return empty
