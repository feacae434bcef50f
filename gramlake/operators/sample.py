"""Sampling and generation by inverse cumulative counts.

Uniform numbers come from an integer generator, so any engine can repeat a
draw.  Short generations run as a recursive query.  Long ones draw from a model
that each task holds, where the model is small; with larger models they run as
recursive queries of a few steps each, between which the lineage is cut.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.operators.model import cdf, most_likely
from gramlake.operators.prefixes import Prefixes, prefixes
from gramlake.operators.score import longest_suffix
from gramlake.sources.scratch import written

#: Fixed values of the linear congruential generator.
MULTIPLIER, INCREMENT, MODULUS = 1_103_515_245, 12_345, 2_147_483_648
#: Rows of a model that a task may hold (about 100 bytes each).
HELD_ROWS = 1_000_000
#: Steps of one recursive query.
ROUND = 20


def lcg(seed: Column) -> Column:
    return F.pmod(seed * F.lit(MULTIPLIER) + F.lit(INCREMENT), F.lit(MODULUS).cast("long"))


def uniform(seed: Column) -> Column:
    return lcg(seed) / F.lit(float(MODULUS))


def sample_next(queries: DataFrame, model: DataFrame) -> DataFrame:
    """``seed, prefix`` -> adds ``match_length, successor`` drawn at the longest known suffix."""
    found = longest_suffix(queries, model).select("prefix", "match", "match_length")
    steps = cdf(model).select(F.col("prefix").alias("match"), "successor", "lo", "hi", "total")
    rows = queries.withColumn("u", uniform(F.col("seed"))).join(found, "prefix").join(steps, "match")
    hit = (F.col("lo") <= F.col("u") * F.col("total")) & (F.col("u") * F.col("total") < F.col("hi"))
    return rows.where(hit).select(*queries.columns, "match_length", "successor")


def generate_sql(prompts: str, table: str, steps: int, block: int, greedy: bool, spark: bool, tokens: bool = False) -> str:
    """Recursive query for generation, in Spark's dialect or the common one.

    ``prompts`` has ``sample, r, text``; ``table`` has ``prefix, successor``
    (and ``lo, hi, total`` unless greedy).  Each step looks up the longest of
    the last ``block`` tokens' suffixes; ``r`` is the state of the generator,
    which draws and moves on at each step.  ``text`` is a string, or an array
    if ``tokens``.
    """
    alias = lambda k: f"m{k}"
    size = f"{'size' if spark else 'len'}(s.text)" if tokens else "length(s.text)"
    if not tokens:
        last = lambda k: f"right(s.text, {k})"
    elif spark:
        last = lambda k: f"slice(s.text, greatest({size} - {k} + 1, 1), {k})"
    else:
        last = lambda k: f"s.text[{size} - {k} + 1:{size}]"
    hit = lambda k: "" if greedy else f" AND {alias(k)}.lo <= s.r / 2147483648.0 * {alias(k)}.total AND s.r / 2147483648.0 * {alias(k)}.total < {alias(k)}.hi"
    joins = " ".join(f"LEFT JOIN {table} {alias(k)} ON {alias(k)}.prefix = {last(k)} AND {size} >= {k}{hit(k)}" for k in range(block, -1, -1))
    pick = "coalesce(" + ", ".join(f"{alias(k)}.successor" for k in range(block, -1, -1)) + ")"
    longer = f"concat(s.text, {pick})" if not tokens else f"concat(s.text, array({pick}))" if spark else f"list_append(s.text, {pick})"
    step = f"CAST((s.r * {MULTIPLIER} + {INCREMENT}) % {MODULUS} AS BIGINT)"
    limit = f" MAX RECURSION LEVEL {steps + 2}" if spark else ""
    return f"""
WITH RECURSIVE g(sample, step, r, text){limit} AS (
  SELECT CAST(sample AS BIGINT), 0, CAST(r AS BIGINT), text FROM {prompts}
  UNION ALL
  SELECT s.sample, s.step + 1, {step}, {longer} FROM g s {joins} WHERE s.step < {steps})
SELECT sample, r, text FROM g WHERE step = {steps}"""


def generate(prompts: DataFrame, model: DataFrame, steps: int, block: int, greedy: bool = False) -> DataFrame:
    """``sample, text`` -> the prompt followed by ``steps`` tokens, drawn under the sample's number as seed.

    A prompt of unknown tokens starts from the unigram counts.  ``text`` is a
    string for a model of characters and an array for a model of tokens.
    """
    kind = prefixes(model)
    table = most_likely(model).select("prefix", "successor") if greedy else cdf(model).select("prefix", "successor", "lo", "hi", "total")
    table = written(table, "generate-steps")
    state = prompts.select(F.col("sample").cast("long").alias("sample"), lcg(F.col("sample").cast("long")).alias("r"), F.col("text").cast(kind.type).alias("text"))
    while True:
        now = min(steps, ROUND)
        state.createOrReplaceTempView("gramlake_prompts")
        table.createOrReplaceTempView("gramlake_steps")
        state = model.sparkSession.sql(generate_sql("gramlake_prompts", "gramlake_steps", now, block, greedy, True, kind.tokens))
        steps -= now
        if not steps:
            return state.select("sample", "text")
        state = written(state, "generate-state")


def generate_long(prompts: DataFrame, model: DataFrame, steps: int, block: int) -> DataFrame:
    """As ``generate`` with draws, for many steps: each task holds the model.

    The number of its rows is checked before anything is sent; a model of more
    than HELD_ROWS rows goes through ``generate``.
    """
    kind = prefixes(model)
    entries = F.array_sort(F.collect_list(F.struct("successor", "n")))
    table = written(model.groupBy("prefix").agg(entries.alias("e")).select("prefix", F.col("e.successor").alias("successor"), F.col("e.n").alias("n")), "generate-model")
    (many,) = table.agg(F.coalesce(F.sum(F.size("n")), F.lit(0))).first()
    if many > HELD_ROWS:
        return generate(prompts, model, steps, block)
    rows = table.toArrow()
    as_key = tuple if kind.tokens else str
    columns = (rows.column(c).to_pylist() for c in ("prefix", "n", "successor"))
    held = {as_key(p): (list(itertools.accumulate(n)), successors) for p, n, successors in zip(*columns)}
    shared = model.sparkSession.sparkContext.broadcast(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [draw(shared.value, kind, int(seed), text, steps, block) for seed, text in zip(frame["sample"], frame["text"])]
            yield pd.DataFrame({"sample": frame["sample"], "text": texts})

    rows = prompts.select(F.col("sample").cast("long").alias("sample"), F.col("text").cast(kind.type).alias("text"))
    return rows.mapInPandas(run, f"sample long, {kind.schema('text')}")


def draw(table: dict, kind: Prefixes, seed: int, text, steps: int, block: int):
    """One sample from a held model: prefix -> (cumulative counts, successors)."""
    key = tuple if kind.tokens else "".join
    r, out = (seed * MULTIPLIER + INCREMENT) % MODULUS, list(text)
    for _ in range(steps):
        found = next((row for k in range(min(block, len(out)), -1, -1) if (row := table.get(key(out[len(out) - k :])))), None)
        if found is None:
            break
        his, successors = found
        out.append(successors[bisect.bisect_right(his, r / MODULUS * his[-1])])
        r = (r * MULTIPLIER + INCREMENT) % MODULUS
    return out if kind.tokens else "".join(out)
