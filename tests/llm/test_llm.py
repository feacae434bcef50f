"""The ten operators against brute force, with nulls, empty tables, ties and clashing columns."""

import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gramlake.llm import bpe, common, lines, mixing, registry, shards, simhash, sstable, toxicity, urls, vectors
from gramlake.llm.components import Forest, connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECS = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(n, t, "en", source, len(t or "")) for n, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "a", "word " * 3000, "é😀 x\ty\n\nz", "same text here now", "same text here now", "<|endoftext|> x", "a\u0000b  c \n d"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- components ----------------------------------------------------------------------------------


def test_components_match_union_find(spark):
    random.seed(2)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(3, 3), (None, 4)]
    low = list(range(60))
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: low[x] for x in touched if low[x] != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest_joins():
    f = Forest(6)
    f.add(np.array([5, 1]), np.array([4, 2]))
    f.add(np.array([4]), np.array([1]))
    assert f.labels().tolist() == [0, 1, 1, 3, 1, 1]


# --- 1: top-k ------------------------------------------------------------------------------------


def brute_topk(vecs, every=50, k=5):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(300)]
    vecs += [(300 + i, vecs[0][1], 1) for i in range(40)]  # ties
    vecs += [(900, None, 1), (950, [1.0, None] * 4, 1), (951, [float("nan")] * 8, 1), (952, [float("inf")] * 8, 0), (None, [1.0] * 8, 1), (1000, [0.0] * 8, None)]
    df = spark.createDataFrame(vecs, VECS).withColumn("v", F.lit("clash"))
    assert sorted(tuple(r) for r in vectors.op1_query(df).collect()) == brute_topk(vecs)
    assert vectors.op1_query(df.limit(0)).count() == 0
    two = df.where("vec_id in (0, 1)")
    assert rows(vectors.op1_query(two), "query_id", "rank", "vec_id") == [(0, 1, 1)]


def test_topk_is_exact_beyond_floats(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 10.0 ** rng.integers(0, 6)], 1) for i in range(250)]
    vecs += [(1000 + i, [float(np.float32(x)) for x in rng.normal(size=8) * 1e6], 1) for i in range(60)]
    vecs += [(2000, [70_000.0] + [0.0] * 7, 1), (2001, [140_000.0] + [0.0] * 7, 1)]
    assert sorted(tuple(r) for r in vectors.op1_query(spark.createDataFrame(vecs, VECS)).collect()) == brute_topk(vecs)
    far = [(0, [0.0, 1e20], 1), (1, [1e30, 0.0], 1), (2, [3.0, 0.0], 1)]
    assert sorted(tuple(r) for r in vectors.op1_query(spark.createDataFrame(far, VECS)).collect()) == brute_topk(far)


def test_a_repeated_query_id_is_its_smallest_vector(spark):
    rng = np.random.default_rng(4)
    others = [(i, [float(x) for x in rng.normal(size=3)], 1) for i in range(1, 40)]
    own = [(0, [1.0, 2.0, -1.0], 1), (0, [1.0, -2.0, 5.0], 1), (0, [1.0, -2.0, 7.0], 1)]
    want = brute_topk([own[1], *others])
    for turned in (own, own[::-1]):
        assert sorted(tuple(r) for r in vectors.op1_query(spark.createDataFrame(turned + others, VECS).coalesce(1)).collect()) == want


def test_queries_in_many_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vecs = [(i, [float(x) for x in rng.normal(size=6)], 1) for i in range(1200)]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    assert sorted(tuple(r) for r in vectors.op1_query(spark.createDataFrame(vecs, VECS)).collect()) == brute_topk(vecs)


def test_annuli_skip_far_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16)) * 4000
    x = np.floor(np.concatenate([c + rng.normal(size=(2000, 16)) * 10 for c in centres]))
    x *= 40000 / np.sqrt((x**2).sum(1))[:, None]
    x = np.floor(x)
    pivots = vectors.choose_pivots(x[::50], 16)
    d = vectors.distances(x, pivots)
    cell = d.argmin(1)
    dist = d[np.arange(len(x)), cell]
    ids = np.arange(len(x))
    o = np.lexsort((ids, dist, cell))
    q_ids = ids[::997]
    at, near, score, work = vectors.search_annuli(ids[o], x[o], cell[o], dist[o], q_ids, x[q_ids], d[q_ids], np.full(len(q_ids), -np.inf), 5)
    exact = x[q_ids] @ x.T
    exact[np.arange(len(q_ids)), q_ids] = -np.inf
    for n in range(len(q_ids)):
        assert sorted(score[at == n], reverse=True) == sorted(exact[n], reverse=True)[:5]
    assert work < 0.5 * len(q_ids) * len(x)


# --- 2: BPE --------------------------------------------------------------------------------------


def test_bpe_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_file("byte_bpe_50k.json")
    model, library = bpe.BpeModel(path), Tokenizer.from_file(path)
    random.seed(4)
    parts = ["a", " ", "  ", "\n", "'s", "é", "😀", "12", "²", "<|endoftext|>", "\u00a0", "the", "Ab!", "\x00", "\x1c"]
    texts = [t or "" for t in ODD] + ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(2000)]
    ids = model.encode_batch(texts)
    for t, i, e in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(i, "<u4").tolist() == e.ids, t
        assert model.decode(i) == library.decode(e.ids, skip_special_tokens=False) == t
    df = docs_of(spark, ODD).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.op2_query(df, path).collect()}
    for n, t in enumerate(ODD):
        assert got[n]["ids_sha256"] == hashlib.sha256(ids[n]).hexdigest()
        assert got[n]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.op2_query(df.limit(0), path).count() == 0


def test_trie_computes_shared_prefixes_once():
    model = bpe.BpeModel(registry.tokenizer_file("byte_bpe_50k.json"))
    nodes = []

    class Path(list):
        def append(self, x):
            nodes.append(x)
            super().append(x)

    model._walk(sorted({b"thorough", b"thoroughly", b"thoroughness"}), Path)
    assert len(nodes) == 3 * (len(b"thoroughly") + len(b"ness"))  # state, last token and its beginning of each node
    assert all(model.encode_words({w})[w] == model.merge(w) for w in (b"abracadabra", b" international", b"zzzzzz", "ünïcödé".encode()))


def test_bpe_of_very_long_texts_and_small_caches(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 50)
    path = registry.tokenizer_file("byte_bpe_50k.json")
    model, library = bpe.BpeModel(path), Tokenizer.from_file(path)
    rng = random.Random(12)
    blob = "".join(rng.choices("abcdefgh", k=30_000))
    texts = [blob, blob + "x", "ab " * 40_000, "\n".join(" ".join(rng.choices(["one", "two.", "drei", "é,", "x\ty"], k=9)) for _ in range(3000))]
    for _ in range(2):
        got = model.encode_batch(texts)
        for t, i, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(i, "<u4").tolist() == e.ids
            assert model.decode(i) == t


# --- 3: SimHash ----------------------------------------------------------------------------------


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, budget=2):
    low = list(range(len(ids)))
    for _ in range(len(ids)):
        for i in range(len(ids)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= budget:
                    low[i] = low[j] = min(low[i], low[j])
    return [min(ids[j] for j in range(len(ids)) if low[j] == low[i]) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choices("abcdef", k=3)) for _ in range(300)]
    texts = ODD + [" ".join(base)] * 3
    for n in range(12):
        w = list(base)
        w[10 * n + 5] = f"x{n}"
        texts.append(" ".join(w))
    df = docs_of(spark, texts).withColumn("fp", F.lit("clash"))
    got = sorted(simhash.op3_query(df).collect())
    fps = [slow_fingerprint(t) for t in texts]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in got] == slow_components(list(range(len(texts))), fps)
    kept = simhash.simhash_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in got})
    assert simhash.op3_query(df.limit(0)).count() == 0
    assert simhash.op3_query(spark.createDataFrame([(None, "a b c", "", "", 0), (7, "a b c", "", "", 0)], DOCS)).count() == 2


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_join_finds_all_links(budget):
    rng = np.random.default_rng(budget)
    seeds = rng.integers(0, 2**63, 30).astype(np.uint64)
    fps = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for s in seeds]))
    low = simhash.trie_links(fps, budget)
    forest = Forest(len(fps))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= budget, 1))
    forest.add(i, j)
    assert low.tolist() == forest.labels().tolist()


def test_near_links_miss_nothing_within_the_budget(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    options = {k: v for k, v in corpus_pipeline.NEAR.items() if k != "shingle"}
    budget, pairs = options["budget"], []
    for bits in range(budget + 3):
        for _ in range(60):
            a, c = (int(x) for x in rng.integers(0, 2**64, 2, dtype=np.uint64))
            b = a ^ sum(1 << int(x) for x in rng.choice(64, bits, replace=False))
            d = c ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 2 * budget + 4)), replace=False))
            pairs += [(a, c), (b, d)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    table = {signed(a): (a, c) for a, c in pairs}
    got = dict(connected_components(simhash.near_links(spark.createDataFrame([(f, signed(c)) for f, (_, c) in table.items()], "fp long, fp2 long"), **options)).collect())
    nodes = sorted(table)
    forest = Forest(len(nodes))
    for i, u in enumerate(nodes):
        for j, v in enumerate(nodes[:i]):
            (a, c), (b, d) = table[u], table[v]
            if (a ^ b).bit_count() <= budget and (c ^ d).bit_count() <= 2 * budget:
                forest.add(np.array([i]), np.array([j]))
    assert [got.get(u, u) for u in nodes] == [nodes[x] for x in forest.labels()]


def test_nodes_dealt_at_any_depth_and_in_chunks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(11)
    seeds = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = np.unique(np.concatenate([s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64), axis=1) for s in seeds]))
    df = spark.createDataFrame([(int(f), 0) for f in fps.view(np.int64)], "fp long, fp2 long")
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1))
    forest = Forest(len(fps))
    forest.add(i, j)
    signed = fps.view(np.int64).tolist()

    def parts(roots):
        out = {}
        for f in signed:
            out.setdefault(roots.get(f, f), set()).add(f)
        return sorted(map(sorted, out.values()))

    want = parts({f: signed[x] for f, x in zip(signed, forest.labels())})
    assert 1 < len(want) < len(signed)
    for bits, chunk in ((0, 131_072), (4, 131_072), (9, 131_072), (3, 7), (0, 50), (32, 131_072)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert parts(dict(connected_components(simhash.near_links(df, 4, bits=bits)).collect())) == want
    monkeypatch.setattr(simhash, "FRONT", 10)
    monkeypatch.setattr(simhash, "CHUNK", 40)
    assert parts(dict(connected_components(simhash.near_links(df, 4)).collect())) == want


def test_a_family_that_shares_its_first_bits_is_dealt_in_chunks(spark, monkeypatch):
    """A third of all fingerprints in one node: parts of it meet each other, and nothing is lost."""
    monkeypatch.setattr(simhash, "CHUNK", 30)
    rng = np.random.default_rng(3)
    family = np.unique(np.uint64(0xABCD << 48) | rng.integers(0, 2**12, 300).astype(np.uint64))
    others = rng.integers(0, 2**63, 600).astype(np.uint64) << np.uint64(1)
    fps = np.unique(np.concatenate([family, others]))
    df = spark.createDataFrame([(int(f), 0) for f in fps.view(np.int64)], "fp long, fp2 long")
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1))
    forest = Forest(len(fps))
    forest.add(i, j)
    want = forest.labels()
    got = dict(connected_components(simhash.near_links(df)).collect())
    groups = lambda names: sorted(sorted(np.flatnonzero(np.array(names) == x)) for x in set(names))
    assert groups([got.get(f, f) for f in fps.view(np.int64).tolist()]) == groups(want.tolist())


def test_node_pairs_are_traversed_and_pruned():
    """10,000 unlike fingerprints: pairs beyond the budget are pruned high up, few fingerprints are compared."""
    rng = np.random.default_rng(10)
    fps = np.unique(rng.integers(0, 2**63, 10_000).astype(np.uint64) << np.uint64(1))
    fps = np.unique(np.concatenate([fps, fps[::7] ^ np.uint64(1 << 40), fps[::9] ^ np.uint64(3 << 62)]))
    work = simhash.Work()
    low = simhash.trie_links(fps, 2, work=work)
    near = [np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 2 for i in range(len(fps))]
    forest = Forest(len(fps))
    for i, hit in enumerate(near):
        forest.add(np.full(int(hit.sum()), i), i + 1 + np.flatnonzero(hit))
    assert low.tolist() == forest.labels().tolist()
    every = len(fps) * (len(fps) - 1) // 2
    assert work.visited > len(fps) and work.pruned > len(fps) and work.compared < every / 20
    assert simhash.Work() == simhash.Work(0, 0, 0)


@pytest.mark.parametrize("budget", range(10))
def test_some_block_differs_little(budget):
    """The tries of a budget begin with blocks that part the bits; one of them differs in few enough."""
    every = simhash.turns(budget)
    assert sum(w for _, w in every) == 64 and [a for a, _ in every] == np.cumsum([0, *(w for _, w in every[:-1])]).tolist()
    assert budget // len(every) <= 2
    x = np.array([1, 2**63 + 5], dtype=np.uint64)
    for by, width in every:
        back = simhash.turned(simhash.turned(x, by), 64 - by) if by else x
        assert (back == x).all()


# --- 4: embeddings -------------------------------------------------------------------------------


def planted_vectors(seed=6, d=64):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(60):
        c = rng.normal(size=d)
        c /= np.linalg.norm(c)
        for _ in range(int(rng.integers(1, 9))):
            noise = rng.normal(size=d)
            noise -= noise @ c * c
            x = c + noise / np.linalg.norm(noise) * rng.uniform(0.02, 0.16)
            out.append((len(out), [float(v) for v in x.astype(np.float32)], g % 3))
    out += [(1000 + i, out[0][1], 0) for i in range(30)] + [(1100, out[0][1], 1), (1101, out[0][1], None), (1102, None, 0), (1103, [0.0] * d, 0), (1104, [float("nan")] * d, 0), (1105, [None] * d, 0)]
    return out


def test_embedding_links_against_brute_force(spark):
    vecs = planted_vectors()
    ok = lambda v, label: v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    x = {i: np.array(v, dtype=np.float64) for i, v, label in vecs if ok(v, label)}
    label = {i: y for i, _, y in vecs}
    ids = sorted(x)
    true = {(i, j) for i in ids for j in ids if i != j and label[i] == label[j] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98}
    got = {r["vec_id"]: r for r in vectors.op4_query(spark.createDataFrame(vecs, VECS).withColumn("n", F.lit(1))).collect()}
    assert len(got) == len(vecs)
    found = sum(r["n_links"] for r in got.values())
    assert found <= len(true) and found >= 0.9 * len(true)
    for i in ids:
        assert got[i]["n_links"] <= sum(1 for a, _ in true if a == i)
    for i in (1101, 1102, 1103, 1104, 1105):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert got[1005]["component_id"] == 0 and got[1005]["n_links"] >= 30
    assert vectors.op4_query(spark.createDataFrame([], VECS)).count() == 0


def test_large_buckets_are_dealt_in_chunks(spark, monkeypatch):
    whole = {r["vec_id"]: tuple(r) for r in vectors.op4_query(spark.createDataFrame(planted_vectors(), VECS)).collect()}
    monkeypatch.setattr(vectors, "CHUNK", 3)
    parts = {r["vec_id"]: tuple(r) for r in vectors.op4_query(spark.createDataFrame(planted_vectors(), VECS)).collect()}
    assert whole == parts


def test_recall_of_the_buckets(spark):
    """Links at cosines from 0.98 on, against brute force over 2,000 pairs."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    angle = np.arccos(rng.uniform(0.98, 0.986, len(a)))[:, None]
    b = np.cos(angle) * a + np.sin(angle) * noise
    for n in (500, 50_000, 2_000_000, 1_000_000_000):
        chosen = vectors.setting(n, 64)
        ka, kb = (vectors.bucket_keys(v, np.zeros(len(v), dtype=np.int64), *chosen) for v in (a, b))
        hit = np.array([len(set(p) & set(q)) > 0 for p, q in zip(ka.tolist(), kb.tolist())])
        assert hit.mean() >= 0.99, chosen


@pytest.mark.parametrize("n, d", [(300, 16), (3000, 32), (12_000, 64)])
def test_embedding_recall_by_size(spark, n, d):
    """Planted links among unlike vectors, at three sizes, against brute force."""
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    for i in range(1, n, 3):
        noise = rng.normal(size=d)
        noise -= noise @ a[i - 1] * a[i - 1]
        a[i] = a[i - 1] + noise / np.linalg.norm(noise) * rng.uniform(0.05, 0.2)
    a = a.astype(np.float32).astype(np.float64)
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(a.tolist())], "vec_id long, embedding array<double>, label int")
    links = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    assert len(links) == n and all(links[i] <= m for i, m in enumerate(near.sum(1).tolist()))
    assert near.sum() > n / 3 and sum(links.values()) >= 0.98 * near.sum()


def test_repeated_vector_ids_do_not_link_unlike_vectors(spark):
    one, other = [1.0, 0.0, 0.5], [0.0, 1.0, -0.5]
    vecs = [(1, one, 0), (1, other, 0), (3, one, 1), (3, one, 2), (5, other, 3), (5, other, 3), (4, other, 3)]
    got = rows(vectors.op4_query(spark.createDataFrame(vecs, VECS)), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 0, 1, True)] * 2 + [(3, 0, 3, True)] * 2 + [(5, 2, 4, False)] * 2 + [(4, 2, 4, True)], key=repr)


def test_components_beyond_floats_count(spark):
    vecs = [(1, [1e300, 1e300], 0), (2, [1e300, 1.01e300], 0), (3, [1e300, -1e300], 0), (4, [1e-300, 0.0], 1), (5, [2e-300, 0.0], 1)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int")
    assert rows(vectors.near_duplicates(df), "vec_id", "n_links", "component_id") == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


# --- 5: mixing -----------------------------------------------------------------------------------


def slow_targets(size):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    left, total, out = set(names), 1.5 * sum(size.values()), {}
    while left:
        unit = total / sum(weight[s] for s in left)
        over = [s for s in left if unit * weight[s] > 2 * size[s]]
        if not over:
            out |= {s: unit * weight[s] for s in left}
            break
        for s in over:
            out[s] = 2.0 * size[s]
            total -= out[s]
            left.discard(s)
    return out


def test_mixing_meets_its_targets(spark):
    random.seed(8)
    data = [(n, " ".join(["w"] * random.randint(0, 40)), "en", random.choice(["a"] * 12 + ["b", "c", "d", "é", None]), 0) for n in range(3000)]
    data += [(5000, None, "en", "a", 0), (5001, None, "en", "empty", 0), (5002, "x\u00a0y z", "en", None, 0)]
    df = spark.createDataFrame(data, DOCS).withColumn("whole", F.lit("clash"))
    got = mixing.op5_query(df).join(df.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(data)
    size = {}
    for _, t, _, s, _ in data:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    want = slow_targets(size)
    taken = {}
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 40
    assert rows(mixing.op5_query(df), "doc_id", "taken") == rows(mixing.op5_query(df.repartition(7)), "doc_id", "taken")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n")).collect()
    assert {s: n for s, n in words if n} == {s: n for s, n in taken.items() if n}
    assert mixing.op5_query(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


# --- 6: URLs -------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://a.example.com/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://X.COM/en/1#f": ("x.com", "/en/1", "com/en/", "block"),
        "http://xcom/en/1": ("xcom", "/en/1", None, "allow"),
        "https://t.example.net/de/8": ("t.example.net", "/de/8", "example.net/de/8", "block"),
        "https://other.net/de/8": ("other.net", "/de/8", "net/de/", "allow"),
        "http://h.org?x=/es/": ("h.org", "", None, "allow"),
        "http://h.org/es/": ("h.org", "/es/", "org/es/", "block"),
        "http://h.org/xxx-video": ("h.org", "/xxx-video", None, "block"),
        "http://h.org/maxxxim": ("h.org", "/maxxxim", None, "allow"),
        "http://h.org/casino/casino": ("h.org", "/casino/casino", None, "allow"),
        "http://h.org/casino/poker1": ("h.org", "/casino/poker1", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/en/": ("b:", "//c/en/", None, "allow"),
    }
    df = spark.createDataFrame([(n, u, "h", "clash") for n, u in enumerate(cases)], "page_id long, url string, html string, host string")
    got = [tuple(r)[1:] for r in sorted(urls.op6_query(df).collect(), key=lambda r: r["page_id"])]
    assert got == list(cases.values())
    assert urls.op6_query(df.limit(0)).count() == 0


# --- 7: toxicity ---------------------------------------------------------------------------------


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["ra", "ne", "ti", "so", "lu", "mi"], k=rng.randint(2, 4)))
    bad = ["grumpf", "zornig", "grumpfest", "zornfall"]
    out = []
    for i in range(n):
        words, y = [word() for _ in range(rng.randint(5, 60))], int(rng.random() < 0.2)
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((" ".join(words).capitalize() + ".", y))
    return out


def test_hard_chains_do_not_follow_the_order_of_documents(monkeypatch):
    monkeypatch.setattr(toxicity, "HARD_CHAINS", 20)
    texts = [f"bad {n}" for n in range(200)] + [f"good {n}" for n in range(50)]
    pick = lambda t: toxicity.hard_chains(t, {"bad"}, lambda x: [x.split()])
    assert pick(texts) == pick(texts[::-1]) and len(pick(texts)) == 20
    assert max(int(n) for _, n in pick(texts)) > 100


def test_toxicity_learns_held_out_documents(spark):
    data = toxic_corpus(900, 1)
    df = docs_of(spark, [t for t, _ in data] + ODD).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(n, 0, y) for n, (_, y) in enumerate(data)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op7_query(df, labels).collect()}
    assert len(got) == len(data) + len(ODD)
    tests = [n for n in range(len(data)) if zlib.crc32(str(n).encode()) % 3 == 1]
    assert all(got[n]["held_out"] == (zlib.crc32(str(n).encode()) % 3 == 1) for n in got)
    assert sum(got[n]["predicted"] == data[n][1] for n in tests) >= 0.97 * len(tests)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[len(data)]["score"] == got[len(data) + 1]["score"] == 0.0
    field = toxicity.fit_on(df, labels)
    spans = [r for r in toxicity.score_documents(df, field).collect() if r["predicted"]]
    text = dict((r["doc_id"], r["text"]) for r in df.collect())
    assert any(text[r["doc_id"]][s["start"] : s["end"]].lower().startswith(("grumpf", "zorn")) for r in spans for s in r["spans"])
    kept = toxicity.keep_clean(df, field)
    assert kept.columns == df.columns and kept.count() == len(got) - len(spans)
    none = toxicity.op7_query(df, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.op7_query(df.limit(0), labels).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = toxicity.Field(t=rng.normal(size=(2, 2)), start=0.3)
    e = rng.normal(size=6)
    total, toxic = 0.0, np.zeros(6)
    for m in range(64):
        y = [m >> i & 1 for i in range(6)]
        s = np.exp(sum(e[i] * y[i] for i in range(6)) + 0.3 * y[0] + sum(field.t[a, b] for a, b in zip(y, y[1:])))
        total += s
        toxic += s * np.array(y)
    assert np.allclose(field.marginals(np.r_[e, e[:2]], np.array([6, 2]))[:6], toxic / total)


def test_gradient_equals_differences_of_the_likelihood():
    rng = np.random.default_rng(6)
    u, t, start = rng.normal(size=5), rng.normal(size=(2, 2)), 0.4
    token = np.array([[0, 3], [1, 4], [2, 0], [3, -1]])
    y = np.array([[1, 0], [0, 1], [1, 1], [0, 0]], dtype=float)
    sizes = np.array([4, 3])

    def likelihood(u, t, start):
        out = 0.0
        for c, n in enumerate(sizes):
            def score(states):
                own = sum(u[token[i, c]] * s for i, s in enumerate(states)) + start * states[0]
                return own + sum(t[a, b] for a, b in zip(states, states[1:]))

            every = [[m >> i & 1 for i in range(n)] for m in range(1 << n)]
            out += score([int(x) for x in y[:n, c]]) - np.log(sum(np.exp(score(s)) for s in every))
        return out

    per_word, grad_t, grad_s = toxicity.Field(t=t, start=start).gradient([(token, y, sizes)], u)
    step = 1e-5
    for i in range(5):
        d = np.eye(5)[i] * step
        assert per_word[i] == pytest.approx((likelihood(u + d, t, start) - likelihood(u - d, t, start)) / (2 * step), abs=1e-6)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = step
            assert grad_t[i, j] == pytest.approx((likelihood(u, t + d, start) - likelihood(u, t - d, start)) / (2 * step), abs=1e-6)
    assert grad_s == pytest.approx((likelihood(u, t, start + step) - likelihood(u, t, start - step)) / (2 * step), abs=1e-6)


def slow_judge(field, text):
    """Score and spans of one text by enumeration-free forward and backward sums, a token at a time."""
    spans, marginals, at = [], [], 0
    for line in text.split("\n"):
        places = [(m.start() + at, m.end() + at) for m in re.finditer(r"\S+", line)]
        at += len(line) + 1
        for s in range(0, len(places), toxicity.CHAIN):
            part = places[s : s + toxicity.CHAIN]
            e = field.unary([text[a:b] for a, b in part])
            weight = np.exp(np.stack([np.zeros(len(e)), e], 1))
            step = np.exp(field.t)
            f, b = np.zeros((len(e), 2)), np.ones((len(e), 2))
            f[0] = weight[0] * np.exp([0, field.start])
            for i in range(1, len(e)):
                f[i] = (f[i - 1] @ step) * weight[i]
                f[i] /= f[i].sum()
            for i in range(len(e) - 2, -1, -1):
                b[i] = step @ (weight[i + 1] * b[i + 1])
                b[i] /= b[i].sum()
            p = (f * b)[:, 1] / (f * b).sum(1)
            marginals += p.tolist()
            for i, (place, x) in enumerate(zip(part, p)):
                if x > 0.5:
                    if i and p[i - 1] > 0.5:
                        spans[-1] = (spans[-1][0], place[1])
                    else:
                        spans.append(place)
    top = sorted((x for x in marginals if x >= toxicity.NOTHING), reverse=True)[:3]
    return 1 - np.prod([1 - x for x in top]), spans


def test_scores_and_spans_equal_a_slow_version():
    rng = np.random.default_rng(4)
    field = toxicity.Field(rng.normal(-0.2, 0.8, toxicity.FEATURES).astype(np.float32), rng.normal(size=(2, 2)), -0.5)
    texts = [t or "" for t in ODD] + [t for t, _ in toxic_corpus(60, 3)] + ["a\x1cb c\td\n\n e.", "word " * 700 + "\nlast"]
    scores, spans = field.judge(texts, 0.0)
    assert sum(map(len, spans)) > 100
    for t, s, found in zip(texts, scores, spans):
        want, places = slow_judge(field, t)
        assert s == pytest.approx(want, abs=1e-9) and found == places == field.offending(t)
    half = field.judge(texts)
    assert half[0] == scores and half[1] == [f if s >= 0.5 else [] for f, s in zip(spans, scores)]


# --- 8: tables -----------------------------------------------------------------------------------


def test_token_tables(spark, tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + ["ΣΟΦΟΣ İstanbul", "ˈ\u1c8a x", "don't STOP"] + [f"document number {n}" for n in range(200)]
    df = docs_of(spark, texts).withColumn("doc_id", F.col("doc_id") * 7 - 500).withColumn("part", F.lit("clash"))
    got = sorted(sstable.op8_query(df, path).collect())
    at = 0
    assert len(got) == len(texts)
    for n, (r, t) in enumerate(zip(got, texts)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (7 * n - 500, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    folder = f"file://{tmp_path}/tables"
    manifest = sstable.write_tables(df, path, folder).orderBy("part").collect()
    assert sum(m["entries"] for m in manifest) == len(texts) and not [p for p in (tmp_path / "tables").iterdir() if p.name[0] == "_"]
    hits = [i for m in manifest for i, v in sstable.look_up(folder, m["file"], [-500, -499, 0, 900, None]).items() if v]
    assert sorted(hits) == sorted(i for i in (-500, -499, 0, 900) if (i + 500) % 7 == 0 and i <= 7 * (len(texts) - 1) - 500)
    assert sstable.op8_query(df.limit(0), path).count() == 0


def test_tables_of_repeated_and_missing_ids(spark, tmp_path, monkeypatch):
    """Fifty files; a third of the rows are one row, others share a doc_id or have none."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(sstable, "FILE_BYTES", 400)
    path = registry.tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    data = [(7, "the same text")] * 300 + [(8, f"text {n}") for n in range(200)] + [(None, f"no id {n}") for n in range(100)]
    data += [(n * 3 - 400, f"document number {n}") for n in range(300)] + [(-(2**63), "least"), (2**63 - 1, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    folder = f"file://{tmp_path}/tables"
    manifest = sstable.write_tables(df.repartition(5), path, folder).orderBy("part")
    files = manifest.collect()
    assert len(files) >= 30 and max(m["entries"] for m in files) <= 120
    back = sstable.read_tables(manifest, folder)
    assert back.rdd.getNumPartitions() >= len(files)
    got = sorted((r["start"], r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in back.collect())
    assert sorted((repr(d), ids) for _, d, ids in got) == sorted((repr(d), tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in data)
    at = 0
    for (start, d, ids), e in zip(got, sorted((d for d, _ in data), key=lambda d: (d is not None, d or 0))):
        assert (start, d) == (at, e)
        at += len(ids)
    least = next(m["file"] for m in files if sstable.look_up(folder, m["file"], [-(2**63)])[-(2**63)])
    assert len(sstable.look_up(folder, least, [-(2**63)])[-(2**63)]) == 1


def test_table_format_round_trips():
    import io

    out = io.BytesIO()
    w = sstable.TableWriter(out, 2)
    for i in range(-3000, 3000, 3):
        w.add(sstable.key_of(i), np.arange(i % 50, dtype="<u2").tobytes())
    w.close()
    r = sstable.TableReader(out, out.tell())
    assert [sstable.id_of(k) for k, _ in r] == list(range(-3000, 3000, 3)) and len(r.index) > 1
    assert all((r.find(i) == [np.arange(i % 50, dtype="<u2").tobytes()]) == (i % 3 == 0) for i in range(-300, 300))
    assert sum(sstable.key_of(i) in r.bloom for i in range(10_000, 14_000)) < 120


# --- 9: shards -----------------------------------------------------------------------------------


def test_shards(spark):
    texts = ODD + [f"text {n}" for n in range(1500)]
    df = docs_of(spark, texts).select("doc_id", "text", F.lit("clash").alias("shard"))
    got = shards.op9_query(df).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 40
    assert max(map(len, by.values())) < 2 * len(texts) / 40
    assert 10 < sum(r["grown_shard"] == 40 for r in got) < 80
    assert rows(shards.op9_query(df.repartition(9)), "doc_id", "shard", "slot") == rows(shards.op9_query(df), "doc_id", "shard", "slot")
    slots = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == got[0]["shard"])
    assert [d for _, d in slots] != sorted(d for _, d in slots)
    assert shards.op9_query(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "b")], "doc_id long, text string")
    assert shards.op9_query(odd).count() == 4


def spark_hash(*values):
    """XXH64 over several values, each seeded by the hash so far, as a signed long."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), h)
    return h - 2**64 if h >> 63 else h


def slow_shards(data, shards_, seed, bucket_bytes):
    """Placement, buckets and Fisher-Yates order, row by row."""
    total = sum(len((t or "").encode()) + 16 for _, t in data)
    buckets = max(1, -(-total // (shards_ * bucket_bytes)))

    def shard(d, n):
        return max([0] + [k for k in range(1, n) if spark_hash(("q", d), ("i", k), ("i", seed)) % (k + 1) == 0])

    held = {}
    for d, t in data:
        held.setdefault((shard(d, shards_), spark_hash(("q", d), ("s", t), ("i", seed + 1)) % buckets), []).append((d, t))
    out, upto = [], {}
    for (s, b), members in sorted(held.items()):
        members.sort(key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] is None, (r[1] or "").encode()))
        picks = np.random.default_rng((seed * 1_000_003 + s * 65_537 + b) % 2**63).random(len(members))
        for i in range(len(members) - 1, 0, -1):
            j = int(picks[i] * (i + 1))
            members[i], members[j] = members[j], members[i]
        for d, t in members:
            slot = upto[s] = upto.get(s, -1) + 1
            out.append((d, zlib.crc32((t or "").encode()), s, slot, shard(d, shards_ + 1)))
    return sorted(out, key=repr)


def test_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 300)
    data = [(n * 7 - 90, t) for n, t in enumerate(ODD)] + [(n, f"text {n % 90}") for n in range(700)] + [(None, f"no id {n}") for n in range(60)] + [(5, f"same id {n}") for n in range(200)] + [(6, "same")] * 9
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("__shard_bucket", F.lit("clash"))
    want = slow_shards(data, 40, shards.SEED, 300)
    for parts in (1, 6):
        assert rows(shards.op9_query(df.repartition(parts)), "doc_id", "text_crc32", "shard", "slot", "grown_shard") == want
    out = shards.shuffle_to_shards(df, shards.scratch_path(spark, "shards"))
    assert out.columns[:3] == df.columns and out.count() == len(data)


def test_buckets_of_a_shard_give_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 200)
    got = shards.op9_query(docs_of(spark, [f"text {n}" for n in range(800)])).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


# --- 10: lines -----------------------------------------------------------------------------------


def test_lines(spark):
    data = [(n, f"Header\n  line {n}\n\nline {n}\r\nFooter {n % 2}", "en", "a", 0) for n in range(20)]
    data += [(100 + n, f"Header\nown {n}", "en", "b", 0) for n in range(4)]
    data += [(200, None, "en", "a", 0), (201, "", "en", "a", 0), (202, "Header", "en", None, 0), (203, "Header\t", "en", "a", 0)]
    df = spark.createDataFrame(data, DOCS).withColumn("host", F.lit("clash")).withColumn("keys", F.lit("clash"))
    out = lines.drop_boilerplate(df, ratio=0.6)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == "  line 0\n\nline 0\r\nFooter 0"
    assert got[100] == "Header\nown 0"  # four pages are too few
    assert (got[200], got[201], got[202], got[203]) == (None, "", "Header", "")
    lower = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df, ratio=0.3).collect()}
    assert lower[0] == "  line 0\n\nline 0\r"
    assert lines.op10_query(df).count() == len(data) and lines.op10_query(df.limit(0)).count() == 0


def test_copies_are_no_boilerplate_in_the_pipeline(spark):
    import corpus_pipeline

    articles = ["\n".join(" ".join(f"article{a} line{n} word{m}" for m in range(20)) for n in range(4)) for a in range(2)]
    texts = articles[:1] * 60 + articles[1:] * 50 + [articles[1] + " \n\n"] * 5 + [None, ""]
    texts += [f"Header\n{' '.join(f'own{n}x{m}' for m in range(20))}\nFooter" for n in range(300)]
    df = docs_of(spark, texts)
    out = corpus_pipeline.drop_lines(spark, df, SF)
    assert out.columns == df.columns
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got[:117] == texts[:117]
    assert got[117:] == [t.split("\n")[1] for t in texts[117:]]
    kept = {r["text"] for r in corpus_pipeline.drop_near_copies(spark, out, SF).collect()}
    assert set(articles) <= kept


# --- odd tables ----------------------------------------------------------------------------------


LONG = " ".join(f"word{n % 977}" for n in range(60_000))
CLASH = ("ids", "fp", "fp2", "part", "size", "key", "n", "host", "score", "shard", "slot", "copies", "whole", "cut", "place", "hash", "part_", "__simhash_kept", "__line_host", "__mix_source", "__shard_first")


def odd_table(spark):
    """Nulls in all columns, repeated rows, a very long text and clashing names."""
    data = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "another text of the same id", "en", "t", 3), (None, None, None, None, None), (None, "no id at all", "en", None, 2)]
    data += [(2, LONG, "en", "s", len(LONG)), (3, LONG + " end", "en", "s", 0), (4, "", "en", "s", 0), (-5, "x\n" * 50_000, "en", "s", 0), (6, "y" * 200_000, "en", "s", 0)]
    return spark.createDataFrame(data, DOCS).withColumns({c: F.lit("clash") for c in CLASH}), data


def test_odd_tables_keep_all_their_rows(spark):
    df, data = odd_table(spark)
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    bpe_path, word_path = (registry.tokenizer_file(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = sorted((repr(d) for d, *_ in data))
    for name, out in (
        ("op2", bpe.op2_query(df, bpe_path)),
        ("op3", simhash.op3_query(df)),
        ("op5", mixing.op5_query(df)),
        ("op7", toxicity.op7_query(df, labels)),
        ("op8", sstable.op8_query(df, word_path)),
        ("op9", shards.op9_query(df)),
        ("op10", lines.op10_query(df)),
    ):
        assert sorted(repr(r["doc_id"]) for r in out.collect()) == ids, name
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_path)
    digests = {hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for _, t, *_ in data}
    assert {r["ids_sha256"] for r in bpe.op2_query(df, bpe_path).collect()} == digests
    same = {r["doc_id"]: r["component_id"] for r in simhash.op3_query(df).collect() if r["doc_id"] in (2, 3)}
    assert set(same) == {2, 3} and len({r["taken"] for r in mixing.op5_query(df).where("doc_id = 1 and size = 6").collect()}) == 1
    kept = simhash.simhash_dedup(df)
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 2
    assert mixing.mixed_documents(df).columns == df.columns and lines.drop_boilerplate(df).count() == len(data)


def test_odd_urls_keep_all_their_rows(spark, tmp_path):
    data = [(1, "http://h.org/en/1"), (1, "http://h.org/en/1"), (None, "http://h.com/en/1"), (None, None), (2, "http://h.org/" + "a/" * 40_000 + "xxx"), (3, "http://h.org/kasino/gratis")]
    df = spark.createDataFrame(data, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "weight")})
    got = sorted(((r["page_id"], r["verdict"]) for r in urls.op6_query(df).collect()), key=repr)
    assert got == sorted([(1, "allow"), (1, "allow"), (None, "block"), (None, "allow"), (2, "block"), (3, "block")], key=repr)
    (tmp_path / "terms").write_text("strict\tFoo\nsoft\tbar\nsoft\tbaz\n\nother\tx\nsoft\t\nstrict\tfoo\n")
    own = urls.vocabulary(spark, str(tmp_path / "terms"))
    assert own == {"strict": ("foo",), "soft": ("bar", "baz")}
    more = spark.createDataFrame([(n, "http://h/" + u) for n, u in enumerate(["FOO", "bar", "bar/baz", "xxx"])], "page_id long, url string")
    assert [r["verdict"] for r in urls.filter_urls(more, **own).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    df, data = odd_table(spark)
    spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows_ = out.count()
            assert rows_ <= 2 * len(data) and (rows_ > 0) == (docs is df), name
            if stage is not corpus_pipeline.encode:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    folder = common.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [x.split("-")[0:2] for x in set(os.listdir(folder)) - before if not re.fullmatch(r"[0-9a-f-]{36}", x)] == [["pipeline", "4"]]


# --- all -----------------------------------------------------------------------------------------


def test_pipeline_against_its_stages_by_hand(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    table = {r["doc_id"]: r for r in docs.collect()}
    toxic = {i for i, p in zip(table, field.score([r["text"] for r in table.values()])) if p >= toxicity.THRESHOLD}
    left = {i: r for i, r in table.items() if i not in toxic}
    per, pages = {}, {}
    for r in left.values():
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for x in {x.strip(lines.BLANKS) for x in r["text"].split("\n")} - {""}:
            per[r["source"], x] = per.get((r["source"], x), 0) + 1
    hot = {k for k, n in per.items() if n >= lines.LEAST_PAGES and n > pages[k[0]] * lines.RATIO}
    text = {i: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(lines.BLANKS)) not in hot) for i, r in left.items()}
    ids = sorted(text)
    one, two = ([simhash.fingerprint(text[i], 5, seed) for i in ids] for seed in (42, 43))
    forest = Forest(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if (one[i] ^ one[j]).bit_count() <= 8 and (two[i] ^ two[j]).bit_count() <= 16:
                forest.add(np.array([i]), np.array([j]))
    comp = [ids[c] for c in forest.labels()]
    kept = [i for i, c in zip(ids, comp) if i == c]
    mixed = mixing.mix(spark.createDataFrame([(i, text[i], "", left[i]["source"], 0) for i in kept], DOCS)).collect()
    model = bpe.BpeModel(registry.tokenizer_file("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], hashlib.sha256(model.encode_batch([text[r["doc_id"]]])[0]).hexdigest()) for r in mixed for _ in range(r["copies"]))
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) > 0


def test_every_query_runs(spark):
    for name, query in registry.queries().items():
        assert query(spark, SF).count() > 0, name
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_encoded_documents_decode_to_themselves(spark):
    path = registry.tokenizer_file("byte_bpe_50k.json")
    df = docs_of(spark, ODD).withColumn("decoded", F.lit("clash"))
    both = bpe.decode_documents(bpe.encode_documents(df, path), path)
    assert {r["doc_id"]: r["decoded"] for r in both.collect()} == {n: t or "" for n, t in enumerate(ODD)}
