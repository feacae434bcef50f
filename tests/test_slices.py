"""Encoding gives a batch of texts back in slices, so a worker never holds its tokens together."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gramlake.functions import automaton
from gramlake.functions.language import Language, greedy


def test_a_slice_at_a_time(monkeypatch):
    """Before, the tokens of all slices of a batch were held and then copied together."""
    monkeypatch.setattr(automaton, "STEP", 64)
    made = automaton.Automaton({"ab": 0, "a": 1, "b": 2})
    texts = pa.array(["abab" * 10, None, "", "ba" * 30] * 20)
    parts = list(made.encoded(texts))
    assert len(parts) > 20 and sum(map(len, parts)) == len(texts)
    assert pa.concat_arrays(parts).equals(made.encode(texts))


def test_slices_keep_their_rows(spark):
    """Slices are not as long as the batches that came: rows still meet their own tokens."""
    rng = random.Random(6)
    language = Language({"the": 1, "th": 2, "e": 3, " ": 4, "é": 5, "t": 6})
    rows = [(n, None if n % 50 == 9 else "".join(rng.choices("the éx", k=rng.choice([0, 5, 900, 40_000] if n % 40 == 0 else [0, 5, 900])))) for n in range(600)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    got = {r["id"]: r["t"] for r in docs.select("id", language.encode(F.col("text")).alias("t")).collect()}
    assert got == {n: None if text is None else greedy(language.pieces, language.depth, text, False) for n, text in rows}
