"""Sorted suffixes, files per token, merged messages and stored models against the plain operators."""

import glob
import gzip
import json
import os
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramlake.functions import automaton, wire
from gramlake.functions.language import Language, greedy
from gramlake.operators import interchange, model, ngrams, score, stored, suffixes
from gramlake.operators.stored import Stored
from gramlake.sources import readers, token_files


def rows(df, *columns):
    return sorted((tuple(x if not isinstance(x, list) else tuple(x) for x in r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


TEXTS = [("abcabcabé😀x\x00y",), ("a" * 700,), (None,), ("",), ("ab",), ("abcd",), ("abcd",), ("the cat sat on the mat " * 30,), ("é" * 50 + "😀" * 50,)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "text string").withColumn("gram", F.lit("clash")).withColumn("k", F.lit(1))


def tokens_of(df, low):
    return df.select(F.transform(ngrams.chars(F.col("text")), lambda c: F.ascii(c) - low).alias("tokens"))


# --- sorted suffixes -----------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 2, 7, 20])
@pytest.mark.parametrize("events", [{}, {"include_last": True}, {"include_start": False}])
def test_deep_counts_equal_exploded_ones(spark, docs, block, events):
    assert rows(suffixes.deep_counts(docs, block, **events), *model.KEY, "n") == rows(ngrams.dense_counts(docs, block, **events), *model.KEY, "n")
    assert rows(suffixes.deep_counts(docs, block, dense=False, **events), *model.KEY, "n") == rows(ngrams.sparse_counts(docs, block, **events), *model.KEY, "n")


@pytest.mark.parametrize("kind", ["int", "bigint", "smallint"])
def test_deep_counts_of_tokens(spark, docs, kind):
    tokens = tokens_of(docs, 101).select(F.transform("tokens", lambda t: t % 900).cast(f"array<{kind}>").alias("tokens"))
    got = suffixes.deep_counts(tokens, 5, "tokens")
    assert got.schema["prefix"].dataType.simpleString() == f"array<{kind}>"
    assert rows(got, *model.KEY, "n") == rows(ngrams.token_counts(tokens, 5), *model.KEY, "n")


def test_deep_counts_of_nothing_and_of_odd_tokens(spark):
    assert suffixes.deep_counts(spark.createDataFrame([], "text string"), 4).count() == 0
    ends = spark.createDataFrame([([-(2**63), 5, 2**63 - 2, 5, -(2**63)],)], "tokens array<bigint>")
    assert rows(suffixes.deep_counts(ends, 2, "tokens"), *model.KEY, "n") == rows(ngrams.token_counts(ends, 2), *model.KEY, "n")
    with pytest.raises(TypeError):
        suffixes.deep_counts(spark.createDataFrame([(["a"],)], "tokens array<string>"), 2, "tokens")
    with pytest.raises(Exception, match="null"):
        suffixes.deep_counts(spark.createDataFrame([([1, None, 3, 4],)], "tokens array<int>"), 2, "tokens").count()


def test_runs_over_any_batches_and_parts():
    """Runs cut by batches are whole; runs cut by parts come out as edges, and add up."""
    rng = random.Random(1)
    grams = sorted([rng.choice([1, 2]) for _ in range(rng.choice([1, 2, 3, 4, 4, 4, 4]))] for _ in range(500))
    want = Counter((len(g[:d]) - 1, tuple(g[:d])) for g in grams for d in range(1, len(g) + 1))
    padded = np.array([g + [0] * (4 - len(g)) for g in grams], dtype=np.uint64)
    for cuts in ([], [250], [1, 2, 3, 200, 499], sorted(rng.sample(range(1, 500), 60))):
        total, final = Counter(), set()
        for part in np.split(padded, cuts):
            runs, edges = suffixes.Runs(4, True), 0
            for at in range(0, len(part), 37):
                for found in runs.add(part[at : at + 37]):
                    edges += _add(found, total, final)
            for found in runs.close():
                edges += _add(found, total, final)
            assert edges <= 8  # two a length
        assert total == want


def _add(found, total, final):
    many, d, n, edge = found
    for row, m, e in zip(many, n, edge):
        key = (d - 1, tuple(int(x) for x in row[:d]))
        assert key not in final
        if not e:
            assert key not in total
            final.add(key)
        total[key] += int(m)
    return int(edge.sum())


def test_one_row_a_position_is_dealt_and_hot_grams_are_split(spark):
    hot = spark.createDataFrame([("a" * 40_000,), ("b" * 400,)], "text string")
    codes = suffixes.deep_counts(hot, 10)
    assert rows(codes, *model.KEY, "n") == rows(ngrams.dense_counts(hot, 10), *model.KEY, "n")
    plan = codes._jdf.queryExecution().toString()
    assert "Generate" not in plan  # nothing is exploded
    grams = spark.range(0, 40_000, 1, 4).select(F.lit("aaa").alias("gram"), F.xxhash64("id").alias("place"))
    sizes = [r["n"] for r in grams.repartitionByRange(8, "gram", "place").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 8_000


# --- messages ------------------------------------------------------------------------------------


def test_parts_of_trees_are_whole_trees(spark, docs):
    node = ngrams.dense_counts(docs, 3)
    back = interchange.tree_rows(interchange.serialized_trees(node))
    code = lambda p: tuple(map(ord, p))
    assert rows(back) == sorted(((k, code(p), ord(s), n) for k, p, s, n in rows(node, *model.KEY, "n") if k), key=repr)
    sparse = ngrams.sparse_counts(docs, 3)  # nodes without counts of their own
    assert rows(interchange.tree_rows(interchange.serialized_trees(sparse, False), False)) == sorted(((k, code(p), ord(s), n) for k, p, s, n in rows(sparse, *model.KEY, "n") if k), key=repr)


def test_trees_name_their_fields(spark):
    node = spark.createDataFrame([(1, [7], 3, 2), (2, [9, 7], 3, 2), (2, [0, 7], 1, 1), (1, [0], 5, 4)], "k int, prefix array<int>, successor int, n long")
    trees = {r["token"]: bytes(r["tree"]) for r in interchange.serialized_trees(node, False).collect()}
    message = wire.unpack("SuffixTree", trees[7])
    assert message["token"] == 7 and message["depth"] == 0 and message["sampler"] == {"total": 2, "counts": [{"token": 3, "count": 2}]}
    assert [(p["token"], p["depth"], p["sampler"]["total"]) for p in message["prefixes"]] == [(0, 1, 1), (9, 1, 2)]
    assert trees[7] == wire.pack("SuffixTree", message)
    assert wire.unpack("SuffixTree", trees[0])["sampler"]["total"] == 4


@pytest.mark.parametrize("fan", [2, 3, 50])
def test_merged_messages_equal_merged_counts(spark, docs, fan):
    rng = random.Random(fan)
    parts = [spark.createDataFrame([("".join(rng.choice("abc") for _ in range(60)),)], "text string") for _ in range(5)]
    nodes = [ngrams.dense_counts(p, 3) for p in parts]
    trees = [interchange.serialized_trees(n) for n in nodes]
    many = trees[0].union(trees[1]).union(trees[2]).union(trees[3]).union(trees[4]).union(trees[0])
    many = many.union(spark.createDataFrame([(None, b""), (5, None)], "token long, tree binary"))
    merged = interchange.merged_trees(many, fan=fan)
    assert merged.groupBy("token").count().where("count > 1").count() == 0
    want = model.merge(*nodes, nodes[0]).where("k > 0")
    assert rows(interchange.tree_rows(merged)) == sorted(((k, tuple(map(ord, p)), ord(s), n) for k, p, s, n in rows(want, *model.KEY, "n")), key=repr)
    assert interchange.merged_trees(many.limit(0)).count() == 0


def test_what_one_tree_has_alone_is_copied():
    one = wire.node_head(5, 0, [(1, 2)]) + wire.framed(wire.BELOW, wire.node_head(3, 1, [(9, 9)]))
    two = wire.node_head(5, 0, [(1, 1), (4, 1)]) + wire.framed(wire.BELOW, b"\x08\x04not read")
    merged = wire.merged_trees([one, two])
    assert b"\x08\x04not read" in merged
    assert wire.tree_parts(merged)[:3] == (5, 0, {1: 3, 4: 1})
    with pytest.raises(wire.WireError):
        list(wire.tree_rows(two))
    for bad in (b"\x08", b"\x1a\x05\x08", b"\x0a\x01a", b"\x22\x7f", b"\x0d\x00\x00\x00\x00"):
        with pytest.raises(wire.WireError):
            list(wire.tree_rows(bad))


# --- files per token -----------------------------------------------------------------------------


@pytest.mark.parametrize("compress", [True, False])
def test_a_file_per_token(spark, docs, tmp_path, compress):
    node, path = ngrams.dense_counts(docs, 3), str(tmp_path / "files")
    said = token_files.write_model(node, path, compress)
    suffix = ".proto.bin" + ".gz" * compress
    tokens = {ord(p) for k, p, _, _ in rows(node, *model.KEY, "n") if k == 1}
    assert {r["token"] for r in said.collect()} == tokens
    for r in said.collect():
        data = open(r["location"], "rb").read()
        assert r["location"] == f"{path}/{r['token']}{suffix}" and len(data) == r["written"]
        plain = gzip.decompress(data) if compress else data
        assert len(plain) == r["rawbytes"] and wire.tree_parts(plain)[0] == r["token"]
    assert rows(readers.trees(spark, f"{path}/*{suffix}", compress)) == rows(interchange.tree_rows(interchange.serialized_trees(node)))
    # written again, smaller: nothing old is left
    small = ngrams.dense_counts(spark.createDataFrame([("zzyzzy",)], "text string"), 2)
    token_files.write_model(small, path, compress)
    assert sorted(os.listdir(path)) == sorted([".statistics.json.crc"] * os.path.exists(f"{path}/.statistics.json.crc") + [f"121{suffix}", f"122{suffix}", "_temporary", "statistics.json"])
    assert not glob.glob(f"{path}/_temporary/*")


def _batch(*parts):
    token, second, data = zip(*parts)
    return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(second, pa.int64()), pa.array(data, pa.binary())], ["token", "second", "part"])


def test_lost_and_repeated_attempts_leave_nothing(tmp_path):
    path = str(tmp_path)
    writer = token_files.TokenWriter(path, True, False)

    def broken():
        yield _batch((1, None, b"one"), (2, None, b"half of"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not glob.glob(f"{path}/*.proto*")
    slow = writer.write(iter([_batch((1, None, b"one"), (1, 4, b" more"))]))  # a repeated attempt that Spark does not take
    taken = [writer.write(iter([_batch((1, None, b"one")), _batch((1, 4, b" more"), (7, 3, b"below"))])), writer.write(iter([])), None]
    assert slow.files[0][1] != taken[0].files[0][1]
    writer.commit(taken)
    assert sorted(os.listdir(path)) == ["1.proto.bin.gz", "7.proto.bin.gz", "_temporary", "statistics.json"] and not os.listdir(f"{path}/_temporary")
    assert gzip.decompress(open(f"{path}/1.proto.bin.gz", "rb").read()) == b"one more"
    assert gzip.decompress(open(f"{path}/7.proto.bin.gz", "rb").read()) == wire.node_head(7, 0, []) + b"below"
    said = [json.loads(x) for x in open(f"{path}/statistics.json")]
    assert [(x["token"], x["rawbytes"]) for x in said] == [(1, 8), (7, len(wire.node_head(7, 0, [])) + 5)]
    again = token_files.TokenWriter(path, True, False)
    again.abort([again.write(iter([_batch((9, None, b"x"))]))])
    assert sorted(os.listdir(path)) == ["1.proto.bin.gz", "7.proto.bin.gz", "_temporary", "statistics.json"] and not os.listdir(f"{path}/_temporary")


# --- stored models -------------------------------------------------------------------------------


@pytest.mark.parametrize("counts", [[1], [1, 1], [3, 1], [1, 2, 3, 4, 90], [7] * 13, [10**12, 1, 1], [5, 5, 1, 1, 28]])
def test_alias_tables_hold_the_counts(counts):
    cuts, aliases = stored.alias_table(counts)
    units = Counter()
    for i, (cut, other) in enumerate(zip(cuts, aliases)):
        assert 0 <= cut <= sum(counts)
        units[i] += cut
        units[other] += sum(counts) - cut
    assert [units[i] for i in range(len(counts))] == [n * len(counts) for n in counts]


@pytest.fixture(scope="module")
def held(spark, docs):
    node = ngrams.dense_counts(docs, 3)
    return SimpleNamespace(node=node, stored=Stored.write(node, buckets=4, parts=8), tokens=ngrams.token_counts(tokens_of(docs, 90), 3))


ASKED = [("abc", "a"), ("abc", "z"), ("zbc", "a"), ("", "a"), ("zzz", "a"), ("e ", "c"), ("😀", "😀"), ("é😀", "x"), ("x", "?")]


def test_stored_lookups_equal_plain_ones(spark, held):
    asked = spark.createDataFrame(ASKED + ASKED[:2], "prefix string, successor string")
    assert rows(held.stored.longest_suffix(asked)) == rows(score.longest_suffix(asked, held.node).select("prefix", "match", "match_length", "total"))
    assert rows(held.stored.matches(asked), "prefix", "successor") == rows(score.matches(asked, held.node), "prefix", "successor")
    for back in (True, False):
        assert rows(held.stored.probabilities(asked, back)) == rows(score.probabilities(asked, held.node, back))
    none = asked.limit(0)
    assert held.stored.longest_suffix(none).count() == held.stored.probabilities(none).count() == 0


def test_stored_lookups_of_tokens(spark, held, docs):
    keep = Stored.write(held.tokens, buckets=3, parts=5)
    asked = tokens_of(docs, 90).where("size(tokens) > 4").select(F.slice("tokens", 2, 3).alias("prefix"), F.element_at("tokens", 5).alias("successor"))
    asked = asked.union(spark.createDataFrame([([], 9), ([999, 7], 1)], "prefix array<int>, successor int"))
    assert rows(keep.longest_suffix(asked)) == rows(score.longest_suffix(asked, held.tokens).select("prefix", "match", "match_length", "total"))
    assert rows(keep.probabilities(asked)) == rows(score.probabilities(asked, held.tokens))


def test_lookups_move_no_model_rows_and_read_few_parts(spark, held):
    asked = spark.createDataFrame([("abc", "a")], "prefix string, successor string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = held.stored.suffixes(asked).join(held.stored.read(held.stored.suffixes(asked)).select(F.col("prefix").alias("match"), "total"), "match")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    scan = plan[: plan.index("FileScan")].rsplit("SortMergeJoin", 1)[1]
    model_side = plan[plan.index("FileScan") :]
    assert "SelectedBucketsCount: 4 out of 4" in model_side
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (=|IN)", model_side)
    assert plan.count("Exchange") == scan.count("Exchange") <= 2  # only the suffixes of the queries move
    assert model_side.count("Exchange") == 0


def test_draws_follow_the_counts(spark, held):
    n = 20_000
    asked = spark.range(n).select(F.col("id").alias("seed"), F.lit("the").alias("prefix")).union(spark.range(n).select("id", F.lit("")))
    got = held.stored.sample(asked)
    assert got.count() == 2 * n
    want = {(r["prefix"], r["successor"]): r["probability"] for r in model.histogram(held.node).where("prefix in ('the', '')").collect()}
    share = {(r["prefix"], r["successor"]): r["n"] / n for r in got.groupBy("prefix", "successor").agg(F.count("*").alias("n")).collect()}
    assert set(share) <= set(want) and all(abs(p - share.get(x, 0)) < 0.015 for x, p in want.items())
    assert rows(got) == rows(held.stored.sample(asked.repartition(3)))


# --- large vocabularies --------------------------------------------------------------------------


@pytest.mark.parametrize("pieces", [{"a": 0}, {"ab": 3, "b": 1, "a": 0, "cab": 7}, {"é": 1, "😀é": 2, "a😀é": -5}, {"abc": 1, "bcab": 2, "\x00": 3}, {}])
def test_automaton_equals_greedy_encoding(pieces, monkeypatch):
    rng, machine = random.Random(len(pieces)), automaton.Automaton(pieces)
    depth = max(map(len, pieces), default=0)
    for size in (automaton.STEP, 40):
        monkeypatch.setattr(automaton, "STEP", size)
        for _ in range(60):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice("abcé😀x\x00") for _ in range(rng.choice([0, 1, 2, 5, 700]))) for _ in range(rng.randrange(9))]
            column = pa.array(["left", *texts, "out"], pa.string()).slice(1, len(texts))
            assert machine.encode(column).to_pylist() == [None if t is None else greedy(pieces, depth, t, False) for t in texts]
    with pytest.raises(ValueError, match="not encodable"):
        machine.encode(pa.array(["aö"]), strict=True)


def test_a_public_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    language = Language.from_ranks(public.path("byte_bpe_50k.tiktoken"))
    assert language.size > 49_000
    texts = ["The quick brown fox, über die Straße – 😀!\n\n  indented", "", "x" * 5000, None, "naïve café " * 300]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", language.encode(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in got] == [None if t is None else greedy(language.pieces, language.depth, t, False) for t in texts]
    back = {t: p for p, t in language.pieces.items()}
    assert all("".join(back[t] for t in r["t"]) == r["text"] for r in got if r["text"] is not None and r["text"].isascii())
