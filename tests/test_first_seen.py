"""Characters in the order in which a corpus shows them, without a copy of the text for each."""

import random

import pytest

from gramlake.functions import language as lang


def brute(rows, key):
    best = {}
    for order, text in rows:
        for at, c in enumerate(text or "", 1):
            best[c] = min(best.get(c, (key(order), at)), (key(order), at))
    return [c for c, _ in sorted(best.items(), key=lambda x: (x[1], x[0]))]


@pytest.mark.parametrize("kind, make", [("long", int), ("string", lambda n: f"é{n:03}"), ("double", float)])
def test_first_seen_in_any_order_of_rows(spark, kind, make):
    rng = random.Random(5)
    rows = [(make(rng.randrange(400)), "".join(rng.choices("abcdefghij é😀ßxyz", k=rng.randrange(4)))) for _ in range(300)] + [(make(7), None), (make(8), "")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    got = [r["piece"] for r in lang.char_language_first_seen(docs).orderBy("token").collect()]
    assert got == brute(rows, lambda x: x)


def test_nulls_come_first_and_nan_last(spark):
    rows = [(float("nan"), "na"), (1.0, "b"), (None, "c"), (float("inf"), "nd")]
    docs = spark.createDataFrame(rows, "doc_id double, text string").coalesce(1)
    assert [r["piece"] for r in lang.char_language_first_seen(docs).orderBy("token").collect()] == ["c", "b", "n", "d", "a"]


def test_no_text_is_copied_or_sorted(spark):
    """Before, each document's text was repeated for each of its characters, and sorted with them."""
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert "Generate" not in lang.char_language_first_seen(docs)._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows", [[], [(3, "cb")], [(n, "abcde"[n % 5 :]) for n in range(40)]])
def test_language_upkeep_in_three_arrivals(spark, tmp_path, rows):
    from gramlake.plans import deep

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = deep.language_upkeep(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lang.char_language_first_seen(docs).collect()))


def test_language_upkeep_holds_no_table_of_all_ids(spark, tmp_path, monkeypatch):
    """Before, the arrivals were parted by two exact percentiles, for which one task held every id."""
    from gramlake.plans import deep

    spark.createDataFrame([(n, "ab") for n in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(deep.F, "percentile", None)
    assert deep.language_upkeep(spark, str(tmp_path)).count() == 2
