"""Streams' upkeep, combiners, models per document, readers in parts and requests as tables."""

import gzip
import json
import lzma
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gramlake.functions import language as lang
from gramlake.functions import udtf, wire
from gramlake.operators import combine, documents, interchange, model, ngrams, requests
from gramlake.sources import readers
from gramlake.streaming import upkeep


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import this file


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def texts_of(spark, texts):
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")


ODD = [None, "", "a", "abc", "abcabc", "é😀" * 9, "the cat sat on the mat " * 5, "x" * 300, "abcabc"]


# --- streams -------------------------------------------------------------------------------------


def test_a_batch_counts_once_whatever_happens(spark, tmp_path):
    table = upkeep.Kept(spark, str(tmp_path / "t"), upkeep.MODEL)
    one, two = (ngrams.sparse_counts(texts_of(spark, t), 2) for t in (["abcabc"], ["cabbage abc"]))
    assert table.read().count() == 0
    assert table.add(one, 0) and not table.add(two, 0)
    # an attempt that was lost before its manifest: data without a name in it
    two.write.parquet(f"{table.path}/level-0/batches-1-1")
    assert rows(upkeep.kept_model(spark, table.path)) == rows(one)
    assert table.add(two, 1) and not table.add(two, 1)
    want = rows(model.merge(one, two))
    assert rows(upkeep.kept_model(spark, table.path)) == want
    for n in range(2, 9):
        table.add(one, n)
        table.compact(model.merge, fan=2)
    assert not table.add(two, 5)  # added up long ago
    assert [(s.level, s.first, s.last) for s in sorted(table.segments(), key=lambda s: s.first)] == [(3, 0, 8)]
    assert rows(upkeep.kept_model(spark, table.path)) == rows(model.merge(two, *[one] * 8))


def test_a_stream_that_is_killed_goes_on(spark, tmp_path, monkeypatch):
    source, path, checkpoint = (str(tmp_path / x) for x in ("source", "model", "checkpoint"))
    texts = ["".join(random.Random(n).choices("abc ", k=80)) for n in range(6)]
    for n, t in enumerate(texts):
        texts_of(spark, [t]).select("text").coalesce(1).write.mode("append").parquet(source)
    commit, calls = upkeep.Kept._commit, []

    def dying(self, segments):
        calls.append(len(segments))
        if len(calls) in (2, 5):
            raise RuntimeError("driver lost")
        commit(self, segments)

    monkeypatch.setattr(upkeep.Kept, "_commit", dying)

    def run():
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(source)
        query = upkeep.keep_model(stream, 2, path, checkpoint, fan=3).trigger(availableNow=True).start()
        query.awaitTermination()

    failures = 0
    for _ in range(4):
        try:
            run()
        except Exception:
            failures += 1
    assert failures == 2
    assert rows(upkeep.kept_model(spark, path)) == rows(ngrams.sparse_counts(texts_of(spark, texts), 2))


@pytest.mark.parametrize("cuts", [[], [1], [4], [2, 3, 7]])
def test_arrivals_give_the_numbers_of_one_pass(spark, tmp_path, cuts):
    docs = [(n, t) for n, t in enumerate(["ba", None, "cab", "", "é😀a", "zyx", "q" * 5, "b😀ü"])]
    ends = [0, *cuts, len(docs)]
    for n, (a, b) in enumerate(zip(ends, ends[1:])):
        part = spark.createDataFrame(docs[a:b], "doc_id long, text string")
        held = upkeep.extend_language(part, str(tmp_path / "v"), n, fan=2)
        again = upkeep.extend_language(part, str(tmp_path / "v"), n, fan=2)  # comes again
        assert rows(held) == rows(again)
    assert rows(held) == rows(lang.char_language_first_seen(spark.createDataFrame(docs, "doc_id long, text string")))


# --- combiners, functions, documents -----------------------------------------------------------------


class Spread(combine.Combiner):
    """Least and greatest value, a state that is no sum."""

    def create(self):
        return None

    def add(self, state, row):
        return row * 2 if state is None else (min(state[0], row[0]), max(state[1], row[0]))

    def merge(self, a, b):
        return min(a[0], b[0]), max(a[1], b[1])

    def extract(self, state):
        return [state]


@pytest.mark.parametrize("held", [1, 3, 100_000])
def test_combined_states(spark, held):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c", ""]), rng.randrange(1000)) for _ in range(500)]
    df = spark.createDataFrame(data, "key string, v long").repartition(7)
    want = {k: (min(v for x, v in data if x == k), max(v for x, v in data if x == k)) for k in {x for x, _ in data}}
    got = combine.combine(df, ["key"], ["v"], Spread(), "low long, high long", held=held)
    assert {r["key"]: (r["low"], r["high"]) for r in got.collect()} == want and got.count() == len(want)
    assert combine.combine(df.limit(0), ["key"], ["v"], Spread(), "low long, high long").count() == 0


def test_pruned_successors_equal_ranked_ones(spark):
    node = ngrams.dense_counts(texts_of(spark, ODD), 3)
    got = combine.combine(node.repartition(5), ["k", "prefix"], ["successor", "n"], combine.TopSuccessors(2), "successor string, n long, place int", held=10, salts=3)
    assert rows(got, "k", "prefix", "successor", "n", "place") == rows(model.top_successors(node, 2), "k", "prefix", "successor", "n", "place")
    tokens = ngrams.token_counts(texts_of(spark, ODD).select(F.transform(ngrams.chars(F.col("text")), F.ascii).alias("tokens")), 2)
    got = combine.combine(tokens, ["prefix"], ["successor", "n"], combine.TopSuccessors(1), "successor int, n long, place int")
    assert rows(got, "prefix", "successor", "n") == rows(model.most_likely(tokens), "prefix", "successor", "n")


def test_table_function_over_batches(spark):
    texts_of(spark, ODD).select("text").createOrReplaceTempView("odd_texts")
    for block in (1, 3):
        udtf.register_counts(spark, block, f"odd_counts_{block}")
        got = spark.sql(f"select k, prefix, successor, sum(n) as n from odd_counts_{block}(table(select text from odd_texts)) group by 1, 2, 3")
        assert rows(got) == rows(ngrams.sparse_counts(texts_of(spark, ODD), block), "k", "prefix", "successor", "n")


@pytest.mark.parametrize("block", [1, 3, 12])
def test_models_of_documents(spark, block):
    texts = [*ODD, "".join(chr(200 + 7 * n) for n in range(400)) * 2]
    docs = texts_of(spark, texts).withColumn("seconds", F.lit("clash"))
    got = {r["doc_id"]: r for r in documents.document_models(docs, block).collect()}
    assert len(got) == len(texts) and all(r["seconds"] > 0 for r in got.values())
    node = ngrams.sparse_counts(texts_of(spark, texts), block, by=("doc_id",)).collect()
    for n, text in enumerate(texts):
        own = [r for r in node if r["doc_id"] == n]
        r = got[n]
        assert r["in_bytes"] == len((text or "").encode())
        assert (r["patterns"], r["prefixes"], r["events"]) == (len(own), len({x["prefix"] for x in own}), sum(x["n"] for x in own))
        assert r["depth"] == max((x["k"] for x in own), default=0)
        assert r["out_bytes"] == sum(len((x["prefix"] + x["successor"]).encode()) + 8 for x in own)


# --- files in parts ------------------------------------------------------------------------------


def test_packed_files_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "STEP", 7)
    texts = {"a.xz": "one\ntwo é😀\n\nthree", "b.xz": "x" * 100 + "\n", "c.xz": "", "d.lzma": "\nlast\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(lzma.compress(text.encode(), format=lzma.FORMAT_ALONE if name.endswith("lzma") else lzma.FORMAT_XZ))
    (tmp_path / "bad.xz").write_bytes(lzma.compress(b"never read\n" * 50)[:-20])
    (tmp_path / "worse.xz").write_bytes(lzma.compress(b"\xff\xfe\n"))
    (tmp_path / "two.xz").write_bytes(lzma.compress(b"first\n") + lzma.compress(b"second"))
    got = sorted(r["line"] for r in readers.xz_lines(spark, str(tmp_path)).collect())
    assert got == sorted(["one", "two é😀", "", "three", "x" * 100, "", "last", "first", "second"])
    with pytest.raises(Exception):
        readers.xz_lines(spark, str(tmp_path), skip_bad=False).count()
    said = {r["path"].rsplit("/", 1)[1]: (r["lines"], r["error"]) for r in readers.xz_report(spark, str(tmp_path)).collect()}
    assert said["a.xz"] == (4, None) and said["c.xz"] == (0, None) and said["two.xz"] == (2, None)
    assert said["bad.xz"][0] == 0 and said["bad.xz"][1].startswith("EOFError") and "Unicode" in said["worse.xz"][1]


def test_a_large_packed_file_takes_little_memory():
    """300 MB of text, unpacked and cut into lines under 100 MB more than before."""
    code = """
import lzma, resource
from gramlake.sources import readers
import io
line = b"a line of a large file that is packed well\\n"
data = lzma.compress(line * 50_000, preset=1) * (300_000_000 // (50_000 * len(line)) + 1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert readers._whole(data, lzma.open) is None
n = sum(len(x) for part in readers._lines(readers._texts(data, lzma.open)) for x in [part])
print(n * len(line), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    size, more = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout.split())
    assert size >= 300_000_000 and more < 100


@pytest.mark.parametrize("step", [1, 5, 1 << 20])
def test_arrays_in_parts(monkeypatch, step):
    monkeypatch.setattr(readers, "STEP", step)
    parts = lambda text: (text[i : i + step] for i in range(0, len(text), step))
    for value in ([], [1], [12345, 6.5, "a,]b", {"x": [1, {"y": "]"}]}, None, True], [{"text": "é😀\n" * 20}] * 5):
        for text in (json.dumps(value), json.dumps(value, indent=3), " \n" + json.dumps(value, ensure_ascii=False) + "\n "):
            assert list(readers._items(parts(text))) == value
    for bad in ("", "{}", "[1", "[1,", "[1 2]", "[1]x", "[,1]", "[1,]", '["a'):
        with pytest.raises(ValueError):
            list(readers._items(parts(bad)))


def test_article_files_in_parts(spark, tmp_path, monkeypatch):
    items = [{"id": str(n), "title": f"t{n}", "text": "é\n" * n, "more": [1]} for n in range(30)] + [{"id": 7, "text": None}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps(items[:2]).encode()))
    (tmp_path / "c.json").write_text("[]")
    got = readers.article_files(spark, str(tmp_path))
    want = [(x["id"] if isinstance(x["id"], str) else "7", x.get("title"), x["text"]) for x in items + items[:2]]
    assert rows(got, "id", "title", "text") == sorted(want, key=repr)
    (tmp_path / "d.json").write_text('[{"id": "lost"}, {"id": ')
    with pytest.raises(Exception):
        readers.article_files(spark, str(tmp_path)).count()
    assert readers.article_files(spark, str(tmp_path), skip_bad=True).count() == len(want)


# --- messages and requests ---------------------------------------------------------------------------


def test_a_set_in_parts_is_one_message(spark):
    node = ngrams.dense_counts(texts_of(spark, ODD), 2)
    parts = interchange.set_messages(node, compress=False)
    whole = b"".join(bytes(r["message"]) for r in parts.collect())
    code = lambda p: list(map(ord, p))
    want = sorted(((k, code(p), ord(s), n) for k, p, s, n in rows(node, "k", "prefix", "successor", "n")), key=repr)
    assert rows(interchange.set_rows(parts, compressed=False)) == want
    assert rows(interchange.model_from_bytes(spark, whole, compressed=False)) == want
    message = wire.unpack("SuffixTreeSet", whole)
    assert message["depth"] == 2 and message["size"] == len(message["prefixes"]) == len({p[-1] for k, p, _, _ in rows(node, "k", "prefix", "successor", "n") if k})
    assert rows(interchange.sampler_rows(interchange.sampler_messages(node))) == want
    assert rows(interchange.model_from_bytes(spark, interchange.model_bytes(node))) == want


def test_requests_as_tables(spark):
    node = ngrams.dense_counts(texts_of(spark, ["the cat sat on the mat " * 9]), 3)
    valid = requests.valid_text(texts_of(spark, ["ab", None, "c"]))
    asked = spark.createDataFrame([(1, "abc"), (2, "abx"), (3, ""), (4, None), (5, "c"), (5, "z")], "doc_id long, text string")
    assert rows(requests.are_valid(asked, valid, "doc_id")) == sorted([(1, True), (2, False), (3, True), (4, None), (5, True), (5, False)], key=repr)
    calls = spark.createDataFrame([(1, "the "), (2, "sat"), (3, None), (4, "x" * 2000)], "request long, text string")
    got = requests.generate_batches(calls, node, 3, 6, 2).collect()
    assert sorted((r["request"], r["draw"]) for r in got if r["error"] is None) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert all(len(r["text"]) == len({1: "the ", 2: "sat"}[r["request"]]) + 6 for r in got if r["error"] is None)
    assert {r["request"]: r["error"] for r in got if r["error"]} == {3: "no prompt", 4: "the prompt is too long"}
    chunks = requests.generate_streams(calls.where("request < 3"), node, 3, 4, 3).collect()
    assert sorted((r["request"], r["batch"], len(r["text"])) for r in chunks) == [(i, n, 4) for i in (1, 2) for n in range(3)]
    for bad in ((0, 1), (5, 0), (5, 11)):
        with pytest.raises(ValueError):
            requests.generate_batches(calls, node, 3, *bad)
