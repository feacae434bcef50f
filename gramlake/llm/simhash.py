"""SimHash near-dedup: 64-bit fingerprints, linked by a binary-trie self-join.

Equal fingerprints are collapsed to one class before anything is joined, so a
group of copies costs one row however large it is.  Sorted fingerprints are a
binary trie: a node is a range that shares a prefix.  The join traverses pairs
of nodes together from the root, a bit at a step; it adds up the bits in which
the prefixes of a pair differ and prunes a pair as soon as these exceed the
budget.

The top of the trie is dealt to tasks: a task takes one pair of nodes a few
bits down whose prefixes are within the budget, and goes on from there.  A
fingerprint is copied to the pairs of its node, a few tens of them; a node that
is large all the same is dealt in chunks.

With large budgets the top of a trie prunes nothing, as its few bits may all
differ.  So a budget of 3 or more takes several tries, each over the bits in
turned order: of r blocks of bits one differs in budget div r bits at most, and
the trie that begins with this block prunes by that smaller budget within it.
Tasks return a spanning forest, never all pairs; distributed star contraction
then gives the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import free_name, groups, map_slices, written
from gramlake.llm.components import Forest, connected_components

#: Fingerprints of a node that is dealt, about; fewest bits down, so that small tables are dealt too.
NODE, LEAST_BITS = 65_536, 4
#: Fingerprints of a node that one task joins; larger nodes are dealt as pairs of chunks.
CHUNK = 131_072
#: Node pairs of at most this many fingerprint pairs are compared; node pairs that are traversed at once.
LEAF_PAIRS, FRONT = 16, 1 << 13
WIDTH = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of ASCII-lower-cased word shingles (repeats count)."""
    return fingerprint_each(text, shingle, (seed,))[0]


def fingerprint_each(text: str | None, shingle: int, seeds: tuple[int, ...]) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * len(seeds)
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) or [b" ".join(words)]
    return [_majority([xxhash.xxh64_intdigest(g, seed) for g in grams]) for seed in seeds]


def _majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(WIDTH, dtype=np.int64)
    for a in range(0, len(hashes), 65536):
        raw = np.array(hashes[a : a + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, second: bool = False) -> DataFrame:
    """``(doc_id, fp, fp2)`` as signed longs; fp2 is one of another seed if ``second``, else 0."""

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            fps = list(zip(*(fingerprint_each(t, shingle, (seed, seed + 1) if second else (seed,)) for t in texts))) or [(), ()]
            signed = [pa.array(np.array(f, dtype=np.uint64).view(np.int64)) for f in fps]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), signed[0], signed[-1] if second else pa.array(np.zeros(len(texts), dtype=np.int64))], ["doc_id", "fp", "fp2"])

        return work

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_slices(docs, "text", make, "doc_id long, fp long, fp2 long")


@dataclass
class Work:
    """What a traversal did: node pairs that were looked at, those pruned by the budget, and fingerprint pairs compared."""

    visited: int = 0
    pruned: int = 0
    compared: int = 0


@dataclass
class Trie:
    """The trie over sorted, distinct fingerprints (from bit ``top`` - 1 down), and links found in it.

    ``seconds`` (of the same order) must differ in at most twice the budget too.
    """

    fps: np.ndarray
    seconds: np.ndarray | None
    budget: int
    forest: Forest
    work: Work = field(default_factory=Work)

    def join(self, a: tuple[int, int], b: tuple[int, int], bit: int, left: int, until: int, within: int) -> None:
        """Link the fingerprints of node ``a`` to those of node ``b``, ranges that share the bits above ``bit``.

        ``left`` is what the prefixes leave of the budget, ``within`` what they
        leave of the smaller budget that holds for the bits down to ``until``.
        """
        start = np.array([[*a, *b, left, within]], dtype=np.int64)
        todo = [(start, bit)]
        while todo:
            front, bit = todo.pop()
            if len(front) > FRONT:  # depth first, so few pairs are held
                todo.append((front[FRONT:], bit))
                front = front[:FRONT].copy()
            if bit == until - 1:
                front[:, 5] = front[:, 4]
            front = self._leaves(front, bit)
            if len(front):
                todo.append((self._step(front, bit), bit - 1))

    def _leaves(self, front: np.ndarray, bit: int) -> np.ndarray:
        """Compare the pairs that are small enough (or have no bit left); return the others."""
        self.work.visited += len(front)
        many = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        small = many <= LEAF_PAIRS if bit >= 0 else np.ones(len(front), dtype=bool)
        for part in (front[small][s : s + FRONT] for s in range(0, int(small.sum()), FRONT)):
            width = part[:, 3] - part[:, 2]
            size = (part[:, 1] - part[:, 0]) * width
            pair = np.repeat(np.arange(len(part)), size)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            i, j = part[pair, 0] + place // width[pair], part[pair, 2] + place % width[pair]
            apart = (part[pair, 0] != part[pair, 2]) | (i < j)
            self.work.compared += int(apart.sum())
            i, j = i[apart], j[apart]
            near = np.bitwise_count(self.fps[i] ^ self.fps[j]) <= self.budget
            i, j = i[near], j[near]
            if self.seconds is not None:
                sure = np.bitwise_count(self.seconds[i] ^ self.seconds[j]) <= 2 * self.budget
                i, j = i[sure], j[sure]
            if len(i):
                self.forest.add(np.minimum(i, j), np.maximum(i, j))
        return front[~small]

    def _step(self, front: np.ndarray, bit: int) -> np.ndarray:
        """The pairs of halves of each pair of nodes that are within the budget; halves by the next bit."""
        ones = np.concatenate([[0], np.cumsum((self.fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]) if self._held != bit else self._ones
        self._held, self._ones = bit, ones
        a, b, c, d, left, within = front.T
        ab, cd = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        unlike = (left > 0) & (within > 0)
        made = [np.stack(x, 1) for x in ((a, ab, c, cd, left, within), (ab, b, cd, d, left, within))]
        across = [np.stack((a, ab, cd, d, left - 1, within - 1), 1)[unlike], np.stack((ab, b, c, cd, left - 1, within - 1), 1)[unlike & ~same]]
        self.work.pruned += int((~unlike).sum() + (~unlike & ~same).sum())
        out = np.concatenate(made + across)
        return out[(out[:, 1] > out[:, 0]) & (out[:, 3] > out[:, 2])]

    _held: int = -1
    _ones: np.ndarray | None = None


def trie_links(fps: np.ndarray, budget: int, seconds: np.ndarray | None = None, work: Work | None = None) -> np.ndarray:
    """Local component label of each of the sorted, distinct unsigned fingerprints.

    Where ``seconds`` are given, these must differ in at most twice the budget too.
    """
    forest = Forest(len(fps))
    if len(fps):
        Trie(fps, seconds, budget, forest, work or Work()).join((0, len(fps)), (0, len(fps)), WIDTH - 1, budget, 0, budget)
    return forest.labels()


def turns(budget: int) -> list[tuple[int, int]]:
    """Bits by which each trie is turned, and the width of the block it then begins with."""
    r = budget // 3 + 1
    ends = [WIDTH * n // r for n in range(r + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def turned(fps: np.ndarray, by: int) -> np.ndarray:
    return fps if not by else (fps << np.uint64(by)) | (fps >> np.uint64(WIDTH - by))


def near_links(classes: DataFrame, budget: int = 2, second: bool = False, bits: int | None = None) -> DataFrame:
    """Spanning edges ``(u, v)`` among distinct ``fp`` (with ``fp2``) that differ in ``budget`` bits or fewer.

    With ``second`` the ``fp2`` of a link must differ in at most twice the
    budget too.  Tries are dealt by the pairs of their nodes ``bits`` down
    (from the number of fingerprints, if not given).
    """
    every = turns(budget)
    least = budget // len(every)
    if bits is None:
        bits = max(LEAST_BITS, (classes.count() // NODE).bit_length())
    # two prefixes and the turn share a number
    bits = min(bits, 24, *(width for _, width in every))
    masks = _masks(bits, least)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["pair", "chunk"]):
            pair, chunk = (t.column(c)[0].as_py() for c in ("pair", "chunk"))
            turn, low, high, i, j = pair >> 48, pair >> 24 & (1 << 24) - 1, pair & (1 << 24) - 1, chunk >> 32, chunk & (1 << 32) - 1
            by, width = every[turn]
            fps = turned(t.column("fp").to_numpy().view(np.uint64), by)
            side = t.column("side").to_numpy().astype(np.int8)
            alone = (low, i) == (high, j)
            order = np.lexsort((fps, side))
            fps, side = fps[order], side[order]
            cut = int(np.searchsorted(side, 1))
            if not alone and cut in (0, len(fps)):
                continue
            seconds = t.column("fp2").to_numpy().view(np.uint64)[order] if second else None
            forest = Forest(len(fps))
            differ = (low ^ high).bit_count()
            a, b = ((0, len(fps)),) * 2 if alone else ((0, cut), (cut, len(fps)))
            Trie(fps, seconds, budget, forest).join(a, b, WIDTH - bits - 1, budget - differ, WIDTH - width, least - differ)
            labels = forest.labels()
            joined = np.flatnonzero(labels != np.arange(len(fps)))
            if len(joined):
                back = turned(fps, WIDTH - by) if by else fps
                yield pa.RecordBatch.from_arrays([pa.array(back[x].view(np.int64)) for x in (joined, labels[joined])], ["u", "v"])

    def top(by: int):
        """The first ``bits`` bits once turned."""
        turn = F.col("fp") if not by else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", WIDTH - by))
        return F.shiftrightunsigned(turn, WIDTH - bits) if bits else F.lit(0).cast("long")

    tops = F.array(*[F.struct(F.lit(n).alias("turn"), top(by).alias("own")) for n, (by, _) in enumerate(every)])
    rows = classes.select("fp", "fp2", F.explode(tops).alias("t")).select("fp", "fp2", "t.turn", "t.own")
    large = rows.groupBy("turn", "own").agg(F.count("*").alias("members")).where(F.col("members") > CHUNK)
    large = written(large.select("turn", F.col("own").alias("node"), F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks")), "simhash-large")
    chunks = lambda df, node, name: df.join(large.select("turn", F.col("node").alias(node), F.col("chunks").alias(name)), ["turn", node], "left").withColumn(name, F.coalesce(name, F.lit(1)))
    rows = chunks(rows, "own", "mine").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("mine")).cast("int"))
    rows = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    # a chunk meets every chunk of every node that is near enough, its own included
    rows = chunks(rows, "other", "theirs").withColumn("their", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    first = (F.col("own") < F.col("other")) | ((F.col("own") == F.col("other")) & (F.col("chunk") <= F.col("their")))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    both = lambda high, low, by: F.shiftleft(high.cast("long"), by).bitwiseOR(low.cast("long"))
    pair = both(F.col("turn"), both(F.least("own", "other"), F.greatest("own", "other"), 24), 48)
    # numbers of a pair and of its chunks are packed: these rows are all that is shuffled
    dealt = rows.select(pair.alias("pair"), both(pick("chunk", "their"), pick("their", "chunk"), 32).alias("chunk"), (~first).alias("side"), "fp", *(["fp2"] if second else []))
    return dealt.repartition("pair", "chunk").sortWithinPartitions("pair", "chunk").mapInArrow(join, "u long, v long")


def _masks(bits: int, most: int) -> list[int]:
    """Numbers of that many bits with at most ``most`` ones."""
    out = {0}
    for _ in range(most):
        out |= {m | 1 << b for m in out for b in range(bits)}
    return sorted(out)


def simhash_components(docs: DataFrame, shingle: int = 3, seed: int = 42, budget: int = 2, second: bool = False) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest doc_id reachable).

    Null or wordless texts have fingerprint 0 and link like any other.  Rows
    that repeat a doc_id each get a row; a null doc_id is kept, and its
    component is the smallest non-null doc_id reachable, else null.  An empty
    table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle, seed, second=second), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("fp2").alias("fp2"))
    roots = connected_components(near_links(classes, budget, second))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    # written by itself, so that the join is broadcast or, where one component is large, split by its true size
    lowest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")).where("members > 1").drop("members"), "simhash-components")
    named = written(rooted.join(lowest, "root", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of one document per component, all columns kept.

    Rows that share a doc_id are one document.  Rows without doc_id stay.
    """
    kept = free_name(docs, "__simhash_kept")
    found = simhash_components(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(found, docs.doc_id.cast("long") == found[kept], "left").where(F.col(kept).isNotNull() | docs.doc_id.isNull()).drop(kept)


def op3_query(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; cases as in ``simhash_components``."""
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
