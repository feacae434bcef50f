"""WARC bundles, hard negatives and spelling variants against brute force, with odd tables."""

import hashlib
import io
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gramlake.llm import common, mixing, negatives, shards, spelling, toxicity, urls, vectors, warc

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECS = "vec_id long, embedding array<float>, label int"


# --- 11: WARC ------------------------------------------------------------------------------------

ODD_PAGES = [
    (1, "http://a/", "<p>x</p>"),
    (7, "http://b/", "<p>x</p>"),
    (3, None, "<p>x</p>"),
    (None, "http://c/\r\nX: y", "<p>x</p>"),
    (4, "http://d/", None),
    (5, "http://d/", ""),
    (6, "é 😀", "é😀\r\n\r\nWARC/1.1\r\n"),
    (8, "http://e/", "long " * 400_000),
    (9, "http://f/", "once"),
    (9, "http://f/", "twice"),
    (10, "http://g/", "again"),
    (10, "http://g/", "again"),
    (None, None, "nobody's"),
]


def expected_pages(pages, least=0):
    top, count = {}, {}
    for p, _, html in pages:
        raw = (html or "").encode()
        count[raw] = count.get(raw, 0) + 1
        if p is not None:
            top[raw] = max(top.get(raw, p), p)
    out = []
    for p, _, html in pages:
        raw = (html or "").encode()
        again = count[raw] > 1 and len(raw) >= least and p != top.get(raw)
        digest = __import__("base64").b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((p, len(raw), digest, "revisit" if again else "response", top.get(raw) if again else None))
    return sorted(out, key=repr)


def test_archives_hold_every_page(spark):
    df = spark.createDataFrame(ODD_PAGES, PAGES).withColumn("__warc_key", F.lit("clash")).withColumn("payload", F.lit(1))
    assert sorted((tuple(r) for r in warc.op11_query(df).collect()), key=repr) == expected_pages(ODD_PAGES)
    assert warc.op11_query(df.limit(0)).count() == 0


def test_short_payloads_are_not_revisited(spark):
    df = spark.createDataFrame(ODD_PAGES, PAGES)
    folder = common.scratch_path(spark, "warc-test")
    back = warc.read_bundles(warc.write_bundles(df, folder, least=6), folder)
    rows = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == expected_pages(ODD_PAGES, 6)


def test_many_copies_and_whole_payloads(spark):
    pages = [(n, f"http://h/{n}", "copy" if n % 3 == 0 else f"<b>{n}</b>" * (n % 50)) for n in range(600)]
    df = spark.createDataFrame(pages, PAGES).repartition(5)
    folder = common.scratch_path(spark, "warc-test")
    manifest = warc.write_bundles(df, folder)
    back = warc.read_bundles(manifest, folder)
    assert sorted((tuple(r) for r in back.drop("url", "html").collect()), key=repr) == expected_pages(pages)
    held = {r["page_id"]: r["html"] for r in back.where("record_type = 'response'").collect()}
    assert all(held[p] == html for p, _, html in pages if p in held)
    assert {r["page_id"]: r["url"] for r in back.collect()} == {p: u for p, u, _ in pages}
    # single records by the map
    index = warc.record_index(manifest, folder)
    assert index.count() == 600 and index.select("record_id").distinct().count() == 600
    some = index.where("page_id in (1, 7, 33, 598)")
    found = {r["page_id"]: (r["html"], r["record_type"]) for r in warc.look_up(index, some, manifest, folder).collect()}
    assert found == {1: ("<b>1</b>", "response"), 7: ("<b>7</b>" * 7, "response"), 33: (None, "revisit"), 598: ("<b>598</b>" * 48, "response")}


def test_bundles_are_plain_zstandard_and_seekable():
    out, names, plain = io.BytesIO(), [], b""
    bundle = warc.BundleWriter(out, frame_bytes=900)
    for n in range(40):
        name, data = warc.record(n, f"http://x/{n}", b"p" * (n * 7), (99,) if n % 4 == 0 else None)
        bundle.add(name, data)
        names.append(name)
        plain += data
    size = bundle.close()
    assert size == len(out.getvalue())
    unpacked = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert unpacked == plain
    reader = warc.BundleReader(out, size)
    assert reader.frames > 10
    for name, frame, offset, length in reader.map():
        fields, block = reader.record(frame, offset)
        assert fields["warc-record-id"] == name and plain.index(reader.frame(frame)[offset : offset + length]) >= 0
    assert [x[0] for x in reader.map()] == names
    empty = io.BytesIO()
    none = warc.BundleReader(empty, warc.BundleWriter(empty).close())
    assert none.frames == 0 and none.map() == []


def test_damage_is_found(spark):
    with pytest.raises(ValueError):
        warc.BundleReader(io.BytesIO(b"x" * 100), 100)
    name, data = warc.record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        warc._row(*warc.parsed(data.replace(b"payload", b"paylord"))[:2])
    with pytest.raises(ValueError):
        warc.parsed(data[:-4] + b"zzzz")


# --- 12: hard negatives --------------------------------------------------------------------------


def brute_negatives(vecs, every=100, positives=5, negatives_=5, relabel=True):
    good = {}
    for i, v, label in vecs:
        if i is None or v is None or label is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        good.setdefault(i, []).append(([int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    for a, held in good.items():
        if a % every:
            continue
        q, own = min(held)
        score = lambda v: sum(x * y for x, y in zip(q, v))
        others = [(-score(v), i, label) for i, rows in good.items() if i != a for v, label in rows]
        for ps, p, _ in sorted(x for x in others if x[2] == own)[:positives]:
            fits = sorted((s, i) for s, i, label in others if label != own and 80 * -ps <= 100 * -s <= 100 * -ps)
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(fits[:negatives_], 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    vecs = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(0, 4))) for i in range(1200)]
    vecs += [(2000 + i, vecs[100][1], i % 3) for i in range(400)]  # a third of the rows is one vector
    vecs += [(5000, None, 1), (5100, [1.0, None] * 3, 1), (5200, [float("nan")] * 6, 1), (5300, [float("inf")] * 6, 0), (None, [1.0] * 6, 1), (5400, [0.0] * 6, 2), (5500, [3.0] * 6, None), (5600, [9.0, 9.0], 3)]
    df = spark.createDataFrame(vecs, VECS).withColumn("v", F.lit("clash")).withColumn("norm", F.lit(0))
    got = sorted(tuple(r) for r in negatives.op12_query(df).collect())
    assert got == brute_negatives(vecs) and len(got) > 100
    assert negatives.op12_query(df.limit(0)).count() == 0
    assert negatives.op12_query(df.where("vec_id % 100 <> 0")).count() == 0


def test_negatives_pass_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    vecs = [(i * 20, [float(x) for x in rng.normal(size=4)], i % 2) for i in range(300)]
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 500)
    monkeypatch.setattr(negatives, "STEP", 7)
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "LONGEST", 10)
    assert sorted(tuple(r) for r in negatives.op12_query(spark.createDataFrame(vecs, VECS)).collect()) == brute_negatives(vecs)


def test_repeated_anchor_is_its_smallest_vector(spark):
    rng = np.random.default_rng(14)
    vecs = [(i, [float(x) for x in rng.normal(size=3)], i % 3) for i in range(1, 90)]
    vecs += [(0, [1.0, 2.0, -1.0], 1), (0, [1.0, -2.0, 5.0], 2), (0, [1.0, -2.0, 5.0], 0), (11, [2.0, 2.0, 2.0], 1)]
    for order in (vecs, vecs[::-1]):
        assert sorted(tuple(r) for r in negatives.op12_query(spark.createDataFrame(order, VECS)).collect()) == brute_negatives(vecs)


def test_buckets_are_pruned_by_norm():
    rng = np.random.default_rng(15)
    x = np.floor(rng.normal(size=(20_000, 8)) * 100 * rng.pareto(1.5, size=20_000)[:, None])
    ids, label = np.arange(len(x)), rng.integers(0, 2, len(x))
    q = x[:50]
    low = np.full(50, vectors.LOWEST)
    windows = negatives.Windows(low, -low, low, 5)
    work = negatives.search(ids, x, label, ids[:50], q, label[:50], np.arange(50), windows, True)
    assert work < 0.2 * 50 * len(x)
    want = np.where((label[None] == label[:50, None]) & (ids[None] != ids[:50, None]), (q @ x.T).astype(np.int64), vectors.LOWEST)
    assert (np.sort(windows.scores, 1) == np.sort(want, 1)[:, -5:]).all()


def test_limits_are_exact():
    scores = np.array([10, 11, 0, -5, 2**62, 9])
    low, high = negatives.limits(scores, Fraction(4, 5), Fraction(1))
    assert low.tolist() == [8, 9, 0, -4, 2**62 - 2**62 // 5, 8] and high.tolist() == scores.tolist()


# --- 13: spelling variants -----------------------------------------------------------------------


def brute_words(docs, every=97, least=3):
    import re

    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 5:
                counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out, form = [], {}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_variants_equal_brute_force(spark):
    rng = random.Random(13)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaab", "ÀÀÀÀÀ", "ààààà", "HELLOÉ", "x" * 3000, "x" * 2999]
    docs = [(n, " ".join(rng.choice(base) if rng.random() < 0.9 else rng.choice(base).upper() for _ in range(rng.randrange(0, 120)))) for n in range(200)]
    docs += [(None, "hello hello hello hello"), (3, None), (4, ""), (5, "  \n"), (6, "jello, jello. jello-jello"), (7, "hellos " * 9), (7, "hellos " * 9)]
    docs += [(300 + n, "kettenn") for n in range(6)] + [(300 + n, "ketten ketten") for n in range(7)] + [(300 + n, "kette kette") for n in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((tuple(r) for r in spelling.op13_query(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    want = brute_variants(brute_words(docs))
    assert got == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    assert spelling.op13_query(df.limit(0)).count() == 0
    assert spelling.op13_query(df.where("text is null")).count() == 0


@pytest.mark.parametrize("word", ["aab", "abcab", "éaa", "a"])
def test_neighbourhood_is_full_and_distinct(word):
    alphabet = "abé"
    want = {word[:i] + word[i + 1 :] for i in range(len(word))}
    want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    want |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    codes = np.array([[ord(c) for c in word]], dtype=np.uint32)
    got = [w for _, made in spelling.neighbours(codes, np.array(sorted(map(ord, alphabet)), dtype=np.uint32)) for w in spelling.as_words(made)]
    assert len(got) == len(set(got)) and set(got) == want - {word}


def test_hashes_of_neighbours_are_those_of_words(monkeypatch):
    """Every neighbour passes a filter that holds just the neighbours, for long words in many parts too."""
    monkeypatch.setattr(spelling, "BLOCK", 64)
    for word in ("abcde", "aabbaabb" * 5):
        codes = np.array([[ord(c) for c in word]], dtype=np.uint32)
        alphabet = np.array([97, 98, 233], dtype=np.uint32)
        every = [w for _, made in spelling.neighbours(codes, alphabet) for w in spelling.as_words(made)]
        assert len(every) == len(set(every)) and all(one_edit(word, w) for w in every)
        bitmap = np.zeros(1 << 14, dtype=np.uint8)
        for _, made in spelling.by_length(every):
            for probe in range(spelling.PROBES):
                at = spelling.spots(spelling.word_hash(made), probe, 8 * len(bitmap))
                np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        assert [w for _, made in spelling.neighbours(codes, alphabet, bitmap) for w in spelling.as_words(made)] == every


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_FILTER_BITS", 1024)
    vocab = spark.createDataFrame([(w, n) for n, w in enumerate(["haus", "maus", "hau", "hauss", "laut", "baum"], 1)], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.near_words(vocab).collect()}
    words = [r["word"] for r in vocab.collect()]
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


# --- mended cases of earlier operators -------------------------------------------------------------


def test_mixing_meets_targets_without_ids(spark):
    """A thousand rows without ids are chosen by their texts, not all alike."""
    data = [(None, f"w{n} " * 10, "en", "a", 0) for n in range(1000)] + [(7, f"v{n} " * 10, "en", "b", 0) for n in range(300)]
    data += [(n, "x " * 10, "en", "c", 0) for n in range(100)]
    df = spark.createDataFrame(data, DOCS)
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 20 for r in got) and len(got) == 3


def test_urls_without_terms(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/1"), (2, "http://porn.example/"), (3, None)], "page_id long, url string")
    for options in ({"strict": (), "soft": ()}, {"strict": ("",), "soft": ()}):
        assert sorted((r["page_id"], r["verdict"], r["weight"]) for r in urls.filter_urls(pages, **options).collect()) == [(1, "block", 0), (2, "allow", 0), (3, "allow", 0)]
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, strict=("porn",), soft=()).collect()}[2] == "block"


def test_one_huge_text_does_not_empty_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200_000)
    words = ["good", "river", "stone", "house", "green", "walk", "paper", "light"]
    rng = random.Random(1)
    line = lambda bad: " ".join(rng.choices(words, k=12) + (["vilescum", "dreckfink"] if bad else [])) + "."
    data = [(n, "\n".join(line(n % 2) for _ in range(3)), "en", "s", 0) for n in range(400)]
    for n in (1, 5, 9):  # longer than all the sample may hold
        data[n] = (n, "\n".join(line(True) for _ in range(6000)), "en", "s", 0)
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i, *_ in data], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.op7_query(docs, labels).collect()}
    assert sum(got[n] for n in range(1, 400, 2)) >= 190 and sum(got[n] for n in range(0, 400, 2)) == 0


def test_alike_rows_fill_many_buckets(spark, monkeypatch):
    """Half of all rows have no id and no text; no bucket holds them together."""
    monkeypatch.setattr(shards, "BUCKET_BYTES", 200)
    data = [(None, "", "en", "s", 0)] * 2000 + [(n, f"text {n}", "en", "s", 0) for n in range(2000)] + [(7, "again", "en", f"s{n % 2}", n % 3) for n in range(60)]
    df = spark.createDataFrame(data, DOCS)
    copy = shards.numbered_repeats(df, "copy")
    assert copy.count() == len(data) and copy.where("copy > 0").count() == 2060
    buckets = shards.bucket_count(sum(16 + len(t) for _, t, *_ in data), 40)
    taken = copy.where("doc_id is null").groupBy(F.pmod(F.xxhash64(F.col("doc_id"), F.col("copy"), F.lit(shards.SEED + 1)), F.lit(buckets))).count()
    assert taken.agg(F.max("count")).first()[0] < 2000 * 4 // buckets + 40
    out = shards.shuffle_to_shards(df, common.scratch_path(spark, "shards-test"))
    back = out.select(*df.columns).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(data, key=repr)
    by = {}
    for r in out.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shards.shuffle_to_shards(df.repartition(3), common.scratch_path(spark, "shards-test"))
    assert sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in again.where("doc_id is not null").collect()) == sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in out.where("doc_id is not null").collect())
