"""The engine against small independent implementations, after the reference's own test strategy."""

import gzip
import json
import lzma
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramlake.functions import language as lang
from gramlake.functions.language import Language
from gramlake.operators import charcount, model, ngrams, sample, score
from gramlake.operators.service import Model, Service
from gramlake.sources import readers, writers
from gramlake.streaming import counts as streaming


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute(texts, block, dense=True, start=True, last=False):
    out = Counter()
    for x in texts:
        if len(x) <= block:
            continue
        for i in range(1 if start else block, len(x) - (0 if last else 1)):
            w = min(block, i)
            for k in range(w + 1) if dense else (w,):
                out[k, x[i - k : i], x[i]] += 1
    return out


def counted(df):
    return Counter({(r["k"], r["prefix"] if isinstance(r["prefix"], str) else tuple(r["prefix"]), r["successor"]): r["n"] for r in df.collect()})


def corpus(seed, n=6, letters="abc😀é\n", most=60):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_counts_equal_brute_force(spark, block):
    texts = corpus(block) + ["", "a", "ab", "a" * block, "a" * (block + 1), "a" * (block + 2)]
    docs = docs_of(spark, texts)
    assert counted(ngrams.dense_counts(docs, block)) == brute(texts, block)
    assert counted(ngrams.sparse_counts(docs, block)) == brute(texts, block, dense=False)
    assert counted(ngrams.sparse_counts(docs, block, include_start=False)) == brute(texts, block, False, start=False)
    assert counted(ngrams.sparse_counts(docs, block, include_last=True)) == brute(texts, block, False, last=True)
    tokens = docs.select(F.transform(ngrams.chars(F.col("text")), lambda c: F.ascii(c)).alias("tokens"))
    by_token = Counter({(k, "".join(map(chr, p)), chr(s)): n for (k, p, s), n in counted(ngrams.token_counts(tokens, block)).items()})
    assert by_token == brute(texts, block)


def test_sparsify_undoes_densify(spark):
    texts = corpus(11, 8)
    sparse = ngrams.sparse_counts(docs_of(spark, texts), 3)
    dense = ngrams.densify(sparse)
    assert counted(ngrams.sparsify(dense)) == counted(sparse)
    assert model.verify(dense).count() == 0


def test_merge_reduce_and_sizes(spark):
    a, b = corpus(1), corpus(2)
    one, two = (ngrams.dense_counts(docs_of(spark, t), 3) for t in (a, b))
    both = model.merge(one, two)
    assert counted(both) == brute(a, 3) + brute(b, 3) == brute(a + b, 3)
    assert counted(model.clean(model.reduce_counts(both, two))) == brute(a, 3)
    node = brute(a, 3)
    inner = {p[1:] for k, p, _ in node if k > 1}
    leaf = {(p, s): n for (k, p, s), n in node.items() if k and p not in inner}
    got = model.sizes(one).first()
    assert (got["prefixes"], got["patterns"], got["occurrences"]) == (len({p for p, _ in leaf}), len(leaf), sum(leaf.values()))
    assert model.depth(one).first()[0] == 3
    assert counted(model.remove_count(one, "", "a", 10**9)) == node


def test_patterns_are_the_prefixes_of_the_next_size(spark):
    docs = docs_of(spark, ["".join(random.Random(3).choices("abcdefgh", k=400))])
    patterns = {r["prefix"] + r["successor"] for r in ngrams.sparse_counts(docs, 3, include_start=False).collect()}
    prefixes = {r["prefix"] for r in ngrams.sparse_counts(docs, 4, include_start=False, include_last=True).collect()}
    assert patterns == prefixes


def test_every_window_matches(spark):
    texts = corpus(4, 4, "ab", 80)
    docs = docs_of(spark, texts)
    node = ngrams.dense_counts(docs, 3)
    windows = ngrams.sparse_counts(docs, 3).select("prefix", "successor")
    assert score.matches(windows, node).count() == windows.count()
    assert score.misses(windows, node).count() == 0
    assert score.probabilities(windows, node).where("probability <= 0").count() == 0


def slow_probability(node, prefix, successor, zero_backs_off):
    total = Counter()
    for (k, p, _), n in node.items():
        total[p] += n
    k = max(k for k in range(len(prefix) + 1) if prefix[len(prefix) - k :] in total)
    p = prefix[len(prefix) - k :]
    own = node[k, p, successor] / total[p]
    return k, own if own > 0 or not zero_backs_off else node[0, "", successor] / total[""]


@pytest.mark.parametrize("zero_backs_off", [True, False])
def test_probabilities(spark, zero_backs_off):
    texts = corpus(5, 5, "abcd", 30)
    node = brute(texts, 3)
    queries = [(p, s) for p in ("", "a", "zz", "zab", "dcb", "abz", "bbb") for s in "abz"]
    got = score.probabilities(spark.createDataFrame(queries, "prefix string, successor string"), ngrams.dense_counts(docs_of(spark, texts), 3), zero_backs_off)
    rows = {(r["prefix"], r["successor"]): (r["match_length"], r["probability"]) for r in got.collect()}
    for q in queries:
        assert rows[q] == pytest.approx(slow_probability(node, *q, zero_backs_off))


def test_perplexity(spark):
    from math import log2

    texts, test = corpus(6, 5, "abc", 40), ["abcabcaab", "zzzzz"]
    node = brute(texts, 2)
    got = {r["doc_id"]: r for r in score.perplexity(docs_of(spark, test), ngrams.dense_counts(docs_of(spark, texts), 2), 2, ("doc_id",)).collect()}
    for n, t in enumerate(test):
        bits = [-log2(slow_probability(node, t[i - 2 : i], t[i], True)[1] or 1e-8) for i in range(2, len(t))]
        assert got[n]["lg_pp"] == pytest.approx(sum(bits) / len(bits))
        assert got[n]["perplexity"] == pytest.approx(2 ** (sum(bits) / len(bits)))


def slow_generate(node, seed, text, steps, block):
    r = (seed * sample.MULTIPLIER + sample.INCREMENT) % sample.MODULUS
    for _ in range(steps):
        k = max(k for k in range(min(block, len(text)) + 1) if any(p == text[len(text) - k :] for _, p, _ in node))
        row = sorted((s, n) for (kk, p, s), n in node.items() if p == text[len(text) - k :])
        u, at = r / sample.MODULUS * sum(n for _, n in row), 0
        for s, n in row:
            at += n
            if u < at:
                text += s
                break
        r = (r * sample.MULTIPLIER + sample.INCREMENT) % sample.MODULUS
    return text


def test_generation(spark):
    texts = corpus(7, 5, "abcd", 40)
    node, df = brute(texts, 2), ngrams.dense_counts(docs_of(spark, texts), 2).persist()
    prompts = spark.createDataFrame([(0, "ab"), (1, "zz"), (2, "")], "sample long, text string")
    want = {n: slow_generate(node, n, t, 6, 2) for n, t in ((0, "ab"), (1, "zz"), (2, ""))}
    assert dict(sample.generate(prompts, df, 6, 2).collect()) == want
    assert dict(sample.generate_long(prompts, df, 6, 2).collect()) == want
    assert all(len(t) == 8 for t in (dict(sample.generate(prompts, df, 6, 2, greedy=True).collect())[n] for n in (0, 1)))


def test_sampling_follows_the_counts(spark):
    rng = random.Random(3)
    weights = {chr(97 + i): rng.randint(1, 100) for i in range(10)}
    node = spark.createDataFrame([(0, "", t, n) for t, n in weights.items()], "k int, prefix string, successor string, n long")
    draws = 1_000_000
    got = sample.sample_next(spark.range(draws).select(F.col("id").alias("seed"), F.lit("").alias("prefix")), node)
    share = {r["successor"]: r["count"] / draws for r in got.groupBy("successor").count().collect()}
    total = sum(weights.values())
    assert max(abs(share[t] - n / total) for t, n in weights.items()) <= 0.001


#: Overlapping pieces; pieces whose parts are no pieces; pieces that only end alike; signs and other scripts.
VOCABULARIES = [("xyx", "xyy", "yx", "x", "y"), ("mnm", "nm", "m"), ("pq", "qp", "p"), ("st", "tst", "stst", "t"), ("ß→", "→", "ß", "€ß→", "€"), (".", "\\", "a.", "(", "[a", "\n")]


def slow_encode(pieces, text):
    out, end = [], len(text)
    while end:
        n = next((n for n in range(end, 0, -1) if text[end - n : end] in pieces), 0)
        if n:
            out.append(pieces[text[end - n : end]])
        end -= n or 1
    return out[::-1]


@pytest.mark.parametrize("pieces", VOCABULARIES)
def test_greedy_encoding(spark, pieces):
    language = Language({p: n for n, p in enumerate(pieces)})
    rng = random.Random(1)
    texts = ["".join(rng.choices("".join(pieces) + "?", k=rng.randint(0, 12))) for _ in range(60)]
    got = docs_of(spark, texts).select("text", language.encode(F.col("text")).alias("t"), language.is_valid(F.col("text")).alias("v"), language.decode(language.encode(F.col("text"))).alias("d")).collect()
    for r in got:
        assert r["t"] == slow_encode(language.pieces, r["text"])
        assert r["v"] == (sum(len(pieces[t]) for t in r["t"]) == len(r["text"]))
        assert not r["v"] or r["d"] == r["text"]


def test_languages(spark):
    docs = docs_of(spark, ["ba😀", "", "cab"])
    assert [tuple(r) for r in lang.char_language(docs).orderBy("token").collect()] == [("a", 0), ("b", 1), ("c", 2), ("😀", 3)]
    assert [r["piece"] for r in lang.char_language_first_seen(docs).orderBy("token").collect()] == ["b", "a", "😀", "c"]
    language = Language.from_corpus(docs)
    assert Language.from_json(language.to_json()).pieces == language.pieces and language.depth == 1 and language.max_token == 3
    got = docs_of(spark, ["a?b😀"]).select(language.encode(F.col("text"))).first()[0]
    assert got == [0, 1, 3]
    assert language.define("abc", 9).depth == 3
    with pytest.raises(ValueError):
        language.define("", 5)
    with pytest.raises(Exception, match="not encodable"):
        docs_of(spark, ["a?"]).select(language.encode(F.col("text"), strict=True)).collect()
    with pytest.raises(Exception, match="unknown token"):
        spark.createDataFrame([([0, 77],)], "t array<int>").select(language.decode(F.col("t"))).collect()
    assert spark.createDataFrame([([0, 77, 1],)], "t array<int>").select(language.decode(F.col("t"), strict=False)).first()[0] == "ab"


def test_segments(spark):
    docs = docs_of(spark, ["".join(random.Random(2).choices("abcde", k=n)) for n in (5, 40, 61, 100)])
    tokens = docs.select("doc_id", ngrams.chars(F.col("text")).alias("tokens"))
    parts = ngrams.split_segments(tokens, 7, 3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d in (1, 2, 3):
        own = sorted((r["segment"], "".join(r["part"])) for r in parts.where(F.col("doc_id") == d).collect())
        assert len(own) == 7 and all(b[1][:3] == a[1][-3:] for a, b in zip(own, own[1:]))
        sizes = [len(p) - (3 if n else 0) for n, p in own]
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    back = {r["doc_id"]: "".join(r["tokens"]) for r in ngrams.merge_segments(parts, 3).collect()}
    assert back == {d: texts[d] for d in (1, 2, 3)}
    got = Counter({(k, "".join(p), s): n for (k, p, s), n in counted(ngrams.segment_counts(parts, 3, 7)).items()})
    assert got == brute([texts[d] for d in (1, 2, 3)], 3)


def test_boundaries_and_delimited(spark):
    df = spark.createDataFrame([([5, 6],)], "tokens array<int>")
    assert ngrams.with_boundaries(df).first()[0] == [0, 5, 6, 1]
    assert spark.createDataFrame([("3,4,5",)], "t string").select(ngrams.delimited_tokens(F.col("t"))).first()[0] == [3, 4, 5]
    cut = ngrams.front_and_rest(spark.createDataFrame([(list(range(100)),)], "tokens array<int>"), 0.8, 3).first()
    assert cut["train"] == list(range(80)) and cut["valid"] == list(range(76, 100))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("z\n")
    (tmp_path / "c.xz").write_bytes(lzma.compress(b"one\ntwo\n"))
    (tmp_path / "d.xz").write_bytes(b"broken")
    (tmp_path / "e.json").write_text(json.dumps([{"id": "1", "title": "t", "text": "é"}, {"id": "2", "title": "u", "text": ""}]))
    p = str(tmp_path)
    assert readers.whole_texts(spark, p + "/a.txt").first()["text"] == "x\ny\n"
    assert sorted(r["line"] for r in readers.text_lines(spark, p + "/*.txt*").collect()) == ["x", "y", "z"]
    assert sorted(r["line"] for r in readers.text_lines(spark, p + "/*.xz").collect()) == ["one", "two"]
    assert bytes(readers.binary_files(spark, p + "/b.txt.gz").first()["data"]) == b"z\n"
    assert sorted(r["line"] for r in readers.text_lines(spark, p + "/[abcd].*").collect()) == ["one", "two", "x", "y", "z"]
    got = readers.article_files(spark, p + "/e.json").orderBy("id").collect()
    assert [r["text"] for r in got] == ["é", ""] and got[0]["src"].endswith("e.json")
    assert readers.list_files(spark, p).count() == 5
    node = ngrams.dense_counts(docs_of(spark, corpus(8)), 2)
    stats = writers.model_by_root(node, p + "/model")
    assert counted(readers.model(spark, p + "/model")) == counted(node)
    assert stats.agg(F.sum("rows")).first()[0] == node.where("k > 0").count()
    writers.json_lines(node, p + "/json", "gzip")
    assert spark.read.json(p + "/json").count() == node.count()
    writers.text_lines(node.select(F.concat("prefix", "successor").alias("line")).where("line not like '%\n%'"), p + "/text")
    spark.sql("create table if not exists kept (char string, n long) using parquet")
    writers.replace_table(charcount.char_counts(docs_of(spark, ["aab"])), "kept")
    assert sorted(map(tuple, readers.table_rows(spark, "kept", ["char"], 5).collect())) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        writers.replace_table(node, "missing")
    assert readers.in_memory(spark, [("gs://b/k/x",)], "u string").select(readers.url_parts(F.col("u")).alias("p")).select("p.*").first() == ("b", "k/x")


def test_streams_equal_batches(spark, tmp_path):
    texts = corpus(9)
    docs = docs_of(spark, texts)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, want in (("c1", streaming.char_counts(stream), charcount.char_counts(docs)), ("c2", streaming.sparse_counts(stream, 2), ngrams.sparse_counts(docs, 2))):
        run = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))


def test_char_counts(spark):
    docs = docs_of(spark, ["aa\nb", "", "\x00é"]).union(spark.createDataFrame([(9, None)], "doc_id long, text string"))
    assert dict(charcount.char_counts(docs, exclude=("\x00",)).collect()) == {"a": 2, "\n": 1, "b": 1, "é": 1}
    lines = charcount.char_counts_of_lines(docs).groupBy("char").agg(F.sum("n")).collect()
    assert dict(map(tuple, lines)) == {"a": 2, "b": 1, "\n": 4, "\x00": 1, "é": 1}


def test_model_and_service(spark, tmp_path):
    docs = docs_of(spark, ["hello world, hello there", "the other world"])
    m = Model.parse_all(docs, 3)
    assert m.match("hel") and not m.match("xyz") and m.search("xxhe") == "he" and m.match_length("xxhe") == 2
    assert m.probability("hel", "l") == 1.0 and m.depth() == 3 and m.memory() > 0
    with pytest.raises(ValueError):
        m.match("")
    assert counted(m.sparsify().densify().node) == counted(m.node)
    assert counted(m.merge(m).reduce(m).node) == counted(m.node)
    m.save(str(tmp_path / "m"))
    assert counted(Model.load(spark, str(tmp_path / "m"), 3).node) == counted(m.node)
    s = Service(m, Language.from_corpus(docs))
    assert set(s.get_valid_text()) == set("hello world, hello there" + "the other world")
    assert s.is_valid_text("hello") == ("hello", True) and s.is_valid_text("HELLO")[1] is False
    assert s.get_model_block_size() == 3
    texts = s.generate_batch(30, 2, text="he")
    assert len(texts) == 2 and all(len(t) == 32 and t.startswith("he") for t in texts)
    chunks = list(s.generate_stream(5, 3, text="hello"))
    assert [len(c) for c in chunks] == [5, 5, 5] and list(s.generate_stream(5, 0, text="h")) == []
    tokens = [s.language.pieces[c] for c in "he"]
    assert s.generate_batch(3, tokens=tokens)[0].startswith("he")
    for bad in (dict(batch_size=0, text="a"), dict(batch_size=5, samples=11, text="a"), dict(batch_size=5), dict(batch_size=5, text="a" * 2000), dict(batch_size=5, tokens=[10**6]), dict(batch_size=5, text="a", request_id="x")):
        with pytest.raises(ValueError):
            s.generate_batch(**bad)


TOKENS = [[7, 300, 7, 7, 12, 300, 7, 300, 12, 12, 7, 300], [12, 7, 300, 7], [5] * 9, [], [1, 2, 3]]


def token_docs(spark, lists=TOKENS):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<int>")


def as_tokens(node):
    """Counts of texts whose characters stand for tokens, with tokens."""
    return Counter({(k, tuple(map(ord, p)), ord(s)): n for (k, p, s), n in node.items()})


def token_texts(lists=TOKENS):
    return ["".join(map(chr, x)) for x in lists]


def test_token_models_equal_brute_force(spark):
    docs = token_docs(spark)
    dense = ngrams.token_counts(docs, 3).persist()
    node = brute(token_texts(), 3)
    assert counted(dense) == as_tokens(node)
    assert counted(ngrams.sparsify(dense)) == as_tokens(brute(token_texts(), 3, dense=False))
    assert counted(ngrams.densify(ngrams.token_counts(docs, 3, dense=False))) == as_tokens(node)
    assert model.verify(dense).count() == 0
    inner = {p[1:] for k, p, _ in node if k > 1}
    leaf = {(p, s): n for (k, p, s), n in node.items() if k and p not in inner}
    got = model.sizes(dense).first()
    assert (got["prefixes"], got["patterns"], got["occurrences"]) == (len({p for p, _ in leaf}), len(leaf), sum(leaf.values()))
    assert model.size(dense).first()[0] == len({p[-1] for k, p, _ in node if k})
    tails = {r["token"]: r["total"] for r in model.children(dense, [7]).collect()}
    want = Counter()
    for (k, p, _), n in node.items():
        if k == 2 and p[1] == chr(7):
            want[ord(p[0])] += n
    assert tails == want
    queries = [(p, s) for p in ([7], [300, 7], [99], [99, 7], [12, 300, 7], []) for s in (7, 300, 99)]
    asked = spark.createDataFrame(queries, "prefix array<int>, successor int")
    rows = {(tuple(r["prefix"]), r["successor"]): (r["match_length"], r["probability"]) for r in score.probabilities(asked, dense).collect()}
    for p, s in queries:
        assert rows[tuple(p), s] == pytest.approx(slow_probability(node, "".join(map(chr, p)), chr(s), True))
    test = [[7, 300, 7, 12, 300], [99, 98, 97, 96]]
    texts = token_texts(test)
    got = {r["doc_id"]: r["lg_pp"] for r in score.perplexity(token_docs(spark, test), dense, 3, ("doc_id",), "tokens").collect()}
    own = {r["doc_id"]: r["lg_pp"] for r in score.perplexity(docs_of(spark, texts), ngrams.dense_counts(docs_of(spark, token_texts()), 3), 3, ("doc_id",)).collect()}
    assert got == pytest.approx(own)
    prompts = spark.createDataFrame([(0, [7, 300]), (1, [99]), (2, [])], "sample long, text array<int>")
    want = {n: list(map(ord, slow_generate(node, n, "".join(map(chr, t)), 25, 3))) for n, t in ((0, [7, 300]), (1, [99]), (2, []))}
    assert dict(sample.generate(prompts, dense, 25, 3).collect()) == dict(sample.generate_long(prompts, dense, 25, 3).collect()) == want


def slow_recursive(node, prefix, successor):
    for k in range(len(prefix), -1, -1):
        p = prefix[len(prefix) - k :]
        total = sum(n for (_, q, _), n in node.items() if q == p)
        if node.get((k, p, successor)):
            return k, node[k, p, successor] / total
    return 0, 0.0


def test_recursive_back_off(spark):
    texts = corpus(5, 5, "abcd", 30)
    node = brute(texts, 3)
    queries = [(p, s) for p in ("", "a", "zz", "zab", "dcb", "abz", "bbb", "cab") for s in "abcz"]
    got = score.recursive_probabilities(spark.createDataFrame(queries, "prefix string, successor string"), ngrams.dense_counts(docs_of(spark, texts), 3))
    rows = {(r["prefix"], r["successor"]): (r["match_length"], r["probability"]) for r in got.collect()}
    for q in queries:
        assert rows[q] == pytest.approx(slow_recursive(node, *q))


def test_large_models_generate_in_rounds(spark, monkeypatch):
    texts = corpus(7, 5, "abcd", 40)
    prompts = spark.createDataFrame([(0, "ab"), (1, "zz")], "sample long, text string")
    df = ngrams.dense_counts(docs_of(spark, texts), 2)
    held = dict(sample.generate_long(prompts, df, 9, 2).collect())
    monkeypatch.setattr(sample, "HELD_ROWS", 3)
    monkeypatch.setattr(sample, "ROUND", 4)
    assert dict(sample.generate_long(prompts, df, 9, 2).collect()) == held


def test_messages(spark, tmp_path):
    from gramlake.functions import wire
    from gramlake.operators import interchange

    language = Language({"a": 0, "ba": 5, "cba": 300, "é": 2, "😀": 70000}, "small")
    again = Language.from_bytes(language.to_bytes())
    assert (again.pieces, again.name) == (language.pieces, "small")
    path = writers.language(spark, language, f"{tmp_path}/l.pb")
    assert path.endswith(".pb.gz") and readers.language(spark, path).pieces == language.pieces
    assert gzip.decompress((tmp_path / "l.pb.gz").read_bytes()) == language.to_bytes()
    (tmp_path / "l.json").write_text(language.to_json())
    assert readers.language(spark, f"{tmp_path}/l.json").pieces == language.pieces
    # a message by hand: one piece "A" with token 1, a field that is not known, and a number for a character
    assert wire.language_pieces(wire.unpack("Language", bytes([0x1A, 7, 0x0A, 1, 0x41, 0x18, 1, 0x20, 1, 0x78, 3]))) == {"A": 1}
    assert wire.language_pieces(wire.unpack("Language", bytes([0x1A, 6, 0x08, 0x41, 0x18, 1, 0x20, 1]))) == {"A": 1}
    for bad in (b"\x1a\x7f", b"\x80", b"\x0b", b"\x0a\x01\xff", b"\x12\x01\x00" + b"\x0d"):
        with pytest.raises(wire.WireError):
            wire.unpack("Language", bad)
    with pytest.raises(wire.WireError):
        wire.unzipped(b"no gzip")
    with pytest.raises(wire.WireError):
        wire.language_pieces({"suffixes": [{"value": c, "token": 1, "atom": True, "prefixes": []} for c in "ab"]})
    message = {"token": 300, "depth": 0, "sampler": {"total": 5, "counts": [{"token": 1, "count": 5}]}, "prefixes": []}
    assert wire.pack("SuffixTree", message) == bytes([0x08, 0xAC, 0x02, 0x1A, 8, 0x08, 5, 0x12, 4, 0x08, 1, 0x10, 5])
    assert wire.from_base64(wire.to_base64(b"abc")) == b"abc"
    for docs, column, characters in ((docs_of(spark, corpus(3)), "text", True), (token_docs(spark), "tokens", False)):
        m = Model.parse_all(docs, 3, text=column)
        for compress in (True, False):
            back = Model.deserialize(spark, m.serialize(compress), 3, compress, characters)
            assert counted(back.node) == counted(m.node)
            trees = m.serialized_trees(compress)
            assert trees.count() == m.size()
            part = counted(interchange.tree_rows(trees, compress))
            want = counted(m.node.where("k > 0"))
            assert part == (as_tokens(want) if characters else want)
    m.serialized_trees().select("tree").rdd  # a plan of its own
    for n, r in enumerate(m.serialized_trees().collect()):
        writers.binary_file(spark, f"{tmp_path}/trees/{n}.pb", bytes(r["tree"]), compress=False)
    assert counted(readers.trees(spark, f"{tmp_path}/trees")) == counted(m.node.where("k > 0"))


def test_stores_by_scheme(spark, tmp_path):
    """s3a and gs paths go through Hadoop's file systems; here both schemes are mounted on a folder."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    for scheme in ("s3a", "gs"):
        conf.set(f"fs.{scheme}.impl", "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme")
        conf.set("fs.viewfs.overload.scheme.target.file.impl", "org.apache.hadoop.fs.LocalFileSystem")
        conf.set("fs.viewfs.mounttable.bucket.link./data", f"file://{tmp_path}")
        base = f"{scheme}://bucket/data"
        assert readers.whole_texts(spark, base + "/x.txt").first()["text"] == "one\ntwo\n"
        assert [r["line"] for r in readers.text_lines(spark, base + "/x.txt").collect()] == ["one", "two"]
        assert readers.list_files(spark, base).count() >= 1
        node = ngrams.dense_counts(docs_of(spark, corpus(8)), 2)
        writers.model_by_root(node, f"{base}/{scheme}-model")
        assert counted(readers.model(spark, f"{base}/{scheme}-model")) == counted(node)
        path = writers.binary_file(spark, f"{base}/{scheme}.bin", b"bytes")
        assert bytes(readers.binary_files(spark, path).first()["data"]) == b"bytes"


def test_server_and_client(spark):
    from gramlake.operators.serving import Client, Server

    docs = docs_of(spark, ["hello world, hello there", "the other world"])
    service = Service(Model.parse_all(docs, 3), Language.from_corpus(docs))
    server = Server(service)
    try:
        client = Client(server.port)
        assert client.healthy()
        assert set(next(client.ask("valid_text"))["text"]) == set(service.language.pieces)
        assert next(client.ask("is_valid_text", text="HELLO")) == {"text": "HELLO", "valid": False}
        assert next(client.ask("model_block_size")) == {"size": 3}
        (got,) = client.ask("generate_batch", text="he", batch_size=5, samples=2, instrument=True)
        assert got["result"] == service.generate_batch(5, 2, text="he") and got["stats"]["gen_time_ns"] >= got["stats"]["gen_freq_ns"] > 0
        assert len(list(client.ask("generate_stream", text="he", batch_size=4, max_batches=2))) == 2
        for verb, request in (("generate_batch", {"text": "he", "batch_size": 0}), ("nothing", {}), ("is_valid_text", {})):
            with pytest.raises(ValueError):
                list(client.ask(verb, **request))
    finally:
        server.close()
    assert not Client(server.port).healthy()


def test_service_over_tokens(spark):
    pieces = Language({p: n for n, p in enumerate(["the ", "cat ", "sat ", "on ", "mat ", "a"])})
    docs = docs_of(spark, ["the cat sat on the mat the cat sat on a", "a cat sat on the mat "]).withColumn("tokens", pieces.encode(F.col("text")))
    m = Model.parse_all(docs, 2, text="tokens")
    assert m.match([0, 1]) and [0, 1] in m and not m.match([5, 5]) and m.search([9, 0]) == [0] and m.match_length([9, 0]) == 1
    assert m.get([0, 1]) == {2: 2} and m.probability([0, 1], 2) == m.probability([0, 1], 2, "recursive") == 1.0
    assert m.sample([0, 1]) == 2 and m.size() == len({r["prefix"][-1] for r in m.node.where("k > 0").collect()})
    assert m.parse([0, 1], 5).get([0, 1]) == {2: 2, 5: 1} and m.parse([0, 1], 5).remove([0, 1], 5).get([0, 1]) == {2: 2}
    assert {r["prefix"][-1] for r in m.json(1).collect()} == {1}
    s = Service(m, pieces)
    (text,), stats = s.generate_batch(4, text="the cat ", instrument=True)
    assert text.startswith("the cat sat ") and len(pieces.encode_text(text)) == 6 and stats["gen_time_ns"] > 0
    assert s.generate_batch(4, tokens=[0, 1])[0] == text
    assert all(len(pieces.encode_text(c)) == 3 for c in s.generate_stream(3, 2, text="the "))
    with pytest.raises(ValueError):
        s.generate_batch(2, text="the dog ")


def test_characters_of_the_private_planes_are_no_tokens(spark):
    docs = docs_of(spark, ["a\U000F0001 \U00100005 b"])
    assert docs.select(Language({"a": 0, "b": 1}).encode(F.col("text"))).first()[0] == [0, 1]
    assert docs.select(Language({"a": 0, "\U000F0001": 1}).encode(F.col("text"))).first()[0] == [0, 1]


def test_short_sequences_raise_if_strict(spark):
    tokens = spark.createDataFrame([(0, [1, 2, 3])], "doc_id long, tokens array<int>")
    assert ngrams.split_segments(tokens, 2, 3).count() == 0
    with pytest.raises(Exception, match="too short"):
        ngrams.split_segments(tokens, 2, 3, strict=True).collect()


def test_public_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from gramlake.functions import tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = docs_of(spark, ["hello world", "", "é😀"]).union(spark.createDataFrame([(9, None)], "doc_id long, text string"))
    got = tokenizer.encode(docs, path, end=50256)
    rows = {r["doc_id"]: r for r in tokenizer.decode(got, path).collect()}
    for d, t in ((0, "hello world"), (1, ""), (2, "é😀")):
        assert rows[d]["tokens"] == library.encode(t, add_special_tokens=False).ids + [50256]
        assert rows[d]["decoded"].startswith(t)
    assert rows[9]["tokens"] is None and rows[9]["decoded"] is None
    node = ngrams.token_counts(got.where("tokens is not null"), 1)
    assert node.count() > 0
    with pytest.raises(ValueError):
        tokenizer.encode(docs, path, unknown="maybe")


def test_spread_leaves_split_scans_alone(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).selectExpr("cast(id as string) text").repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    spark.range(10).selectExpr("cast(id as string) text").coalesce(1).write.parquet(str(tmp_path / "one"))
    shuffles = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Repartition")
    spark.conf.set("spark.sql.files.openCostInBytes", "100000000")
    try:
        assert shuffles(ngrams.spread(spark.read.parquet(str(tmp_path / "many")))) == 0
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert shuffles(ngrams.spread(spark.read.parquet(str(tmp_path / "one")))) == 1


def test_table_function(spark):
    from gramlake.functions import udtf

    udtf.register(spark)
    docs_of(spark, ["abcab", "ab", ""]).createOrReplaceTempView("texts")
    got = Counter((r["k"], r["prefix"], r["successor"]) for r in spark.sql("select n.* from texts, lateral ngrams(text, 2) n").collect())
    assert got == brute(["abcab", "ab", ""], 2, dense=False)


def test_command_line(spark, tmp_path, capsys):
    from gramlake.__main__ import main

    (tmp_path / "c.txt").write_text("the cat sat on the mat, the cat ran\n" * 5)
    assert main(["-c", str(tmp_path / "c.txt"), "-b", "3", "-s", "--memory", "-v", "0.8", "-g", "30", "-p", "the ", "-m", str(tmp_path / "m"), "-o", str(tmp_path / "out.txt")]) == 0
    assert (tmp_path / "out.txt").read_text().startswith("the ") and len((tmp_path / "out.txt").read_text()) == 34
    assert "prefixes" in capsys.readouterr().err
    assert main(["-m", str(tmp_path / "m"), "-b", "3", "-g", "10", "-p", "cat"]) == 0
    assert capsys.readouterr().out.startswith("cat")
