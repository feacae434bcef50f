"""Grams that tasks count before the shuffle, against a plain count."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from gramlake.operators import ngrams, suffixes


def plain(texts, block, start, last):
    out = Counter()
    for t in texts:
        if t is not None and len(t) > block:
            out.update(t[max(0, i - block) : i + 1] for i in range(1 if start else block, len(t) if last else len(t) - 1))
    return out


TEXTS = [None, "", "ab", "a" * 50, "né😀\n\x00é " * 4] + ["".join(random.Random(n).choices("abcdé😀 \n", k=n % 37)) for n in range(120)]


@pytest.mark.parametrize("start, last", [(True, False), (False, True)])
@pytest.mark.parametrize("block", [1, 3, 10, 20])
def test_grams_of_a_slice(block, start, last):
    got = suffixes.gram_counts(pa.array(TEXTS), block, start, last)
    assert dict(zip(got["gram"].to_pylist(), got["n"].to_pylist())) == plain(TEXTS, block, start, last)


def test_grams_of_a_large_alphabet():
    texts = ["".join(chr(0x4E00 + (n * 7919 + i * i) % 20000) for i in range(300)) for n in range(200)]
    got = suffixes.gram_counts(pa.array(texts), 3)
    assert dict(zip(got["gram"].to_pylist(), got["n"].to_pylist())) == plain(texts, 3, True, False)


def test_counts_meet_the_shuffle_as_distinct_grams(spark):
    """Before, every position was a row of an explode."""
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(2)
    counts = ngrams.sparse_counts(docs, 3)
    assert "Generate" not in counts._jdf.queryExecution().toString()
    assert {r["prefix"] + r["successor"]: r["n"] for r in counts.collect()} == plain(TEXTS, 3, True, False)
