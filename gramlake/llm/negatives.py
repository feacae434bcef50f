"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm, longest first, and cut into buckets.  No score
of a bucket exceeds |anchor| times its largest norm (Cauchy-Schwarz), so a
bucket is skipped for a window whose lower limit, or running k-th score, is
above that product; and as norms fall from bucket to bucket, a window that
skips one is done.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import scratch_path, written
from gramlake.llm.vectors import LOWEST, exact_scores, matrix, whole_vectors

#: Anchors are rows whose vec_id this divides; rows whose vec_id RELABEL divides get the next of CLASSES labels.
EVERY, RELABEL, CLASSES = 100, 7, 10
POSITIVES = NEGATIVES = 5
#: A negative scores between these shares of its positive.
LOW, HIGH = Fraction(80, 100), Fraction(1)
#: Rows of a bucket, and of a part of the index.
BUCKET, PART = 512, 20_000
#: Bytes of the anchors that go over the index at once; they are all that is sent to executors.
BLOCK_BYTES = 16_000_000
#: Anchors that a task scores at once.
STEP = 512
#: The longest rows, from which windows take their first bounds.
LONGEST = 2048


def labelled(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v, label`` of usable rows: floor(256 * x) of every component, labels as the contract changes them."""
    rows = whole_vectors(embeddings.where("label is not null"), carry=("label",))
    label = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return rows.select("vec_id", "v", label.cast("long").alias("label"))


class Windows:
    """The best ``k`` rows of every window (anchor, lowest and highest score) met so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, need: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((len(low), k), LOWEST)
        self.ids = np.full((len(low), k), np.iinfo(np.int64).max)
        self.need = need.copy()  # a score that ``k`` rows are known to reach, or the lower limit

    def offer(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of rows ``ids`` for windows ``which`` (a row each); those outside a window are LOWEST already or fall out."""
        hit = np.flatnonzero(((scores >= self.need[which, None]) & (scores <= self.high[which, None])).any(1))
        which, scores = which[hit], scores[hit]
        if not len(which):
            return
        fit = (scores >= self.low[which, None]) & (scores <= self.high[which, None]) & (scores > LOWEST)
        every = np.concatenate([self.scores[which], np.where(fit, scores, LOWEST)], 1)
        names = np.concatenate([self.ids[which], np.where(fit, ids[None], np.iinfo(np.int64).max)], 1)
        order = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.scores[which], self.ids[which] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
        self.need[which] = np.maximum(self.need[which], self.scores[which, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.scores > LOWEST)
        return at, self.ids[at, place], self.scores[at, place]


def search(ids: np.ndarray, x: np.ndarray, label: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_label: np.ndarray, owner: np.ndarray, windows: Windows, same: bool) -> int:
    """Offer the rows to the windows of their anchors (``owner``: an anchor of each window), bucket by bucket.

    Rows of the anchor's label are offered if ``same``, those of other labels
    if not; never the anchor's own vec_id.  Returns the number of (anchor,
    row) scores that were computed.
    """
    norm = np.sqrt((x**2).sum(1))
    order = np.lexsort((ids, -norm))
    ids, x, label, norm = ids[order], x[order], label[order], norm[order]
    length = np.sqrt((q**2).sum(1))[owner]
    open_, work = np.flatnonzero(windows.low <= windows.high), 0
    for a in range(0, len(ids), BUCKET):
        # norms are rounded: the slack is relative, and absolute for scores near zero
        bound = length[open_] * norm[a] * (1 + 1e-9) + 1e-6
        open_ = open_[bound >= windows.need[open_]]
        if not len(open_):
            break
        b = a + BUCKET
        asked, which = np.unique(owner[open_], return_inverse=True)
        own = q_ids[asked, None] == ids[None, a:b]
        own |= (q_label[asked, None] == label[None, a:b]) != same
        scores = exact_scores(q[asked], x[a:b], own)
        work += scores.size
        for s in range(0, len(open_), 4 * STEP):
            windows.offer(open_[s : s + 4 * STEP], ids[a:b], scores[which[s : s + 4 * STEP]])
    return work


def _whole(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


def limits(scores: np.ndarray, low: Fraction, high: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores from ``low`` to ``high`` times each positive's, in exact arithmetic; none where the first is above the second."""
    pairs = [(_whole(low * s), (high * s).__floor__()) for s in scores.tolist()]
    out = np.array(pairs, dtype=object).reshape(-1, 2)
    return np.clip(out[:, 0], LOWEST + 1, -LOWEST).astype(np.int64), np.clip(out[:, 1], LOWEST, -LOWEST).astype(np.int64)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: Fraction = LOW, high: Fraction = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, v`` (whole numbers as doubles) and ``label``.
    Anchors are the rows whose vec_id ``every`` divides; an anchor's positives
    are its best rows of the same label, and each positive's negatives the best
    rows of other labels that score from ``low`` to ``high`` times as much.
    Ties go to the smaller vec_id.  Rows with the anchor's vec_id are neither;
    a repeated anchor id is one anchor (its smallest vector, then label); other
    repeated rows count each.  Shorter vectors count as padded with zeros.  An
    anchor without positives, and a positive without negatives (also every one
    that scores below zero), gives no rows, nor does an empty table.

    The index is dealt by range over (norm, vec_id), so equal vectors, however
    many, are cut into parts of bounded size.  Anchors pass in blocks of bounded
    bytes: first for positives, then for negatives; per anchor or window each
    part returns its k best at most.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    vectors = written(vectors.select("vec_id", "v", "label").withColumn("norm", norm), "negatives-vectors")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(int(width or 0), 1)
    parts = max(1, -(-int(n) // PART), spark.sparkContext.defaultParallelism)
    index = written(vectors.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id").drop("norm"), "negatives-index")
    anchors = vectors.where(F.col("vec_id") % every == 0).drop("norm")
    blocks = max(1, -(-anchors.count() * width * 8 // BLOCK_BYTES))
    anchors = written(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(blocks, "block"), "negatives-anchors")
    longest = vectors.orderBy(F.desc("norm"), "vec_id").limit(LONGEST).toArrow()
    longest = longest.column("vec_id").to_numpy(), matrix(longest.column("v"), width), longest.column("label").to_numpy()
    best = scratch_path(spark, "negatives-found")
    for block in range(blocks):
        got = anchors.where(F.col("block") == block).toArrow()
        q_ids, q, q_label = got.column("vec_id").to_numpy(), matrix(got.column("v"), width), got.column("label").to_numpy()
        order = np.lexsort((q_label, *q.T[::-1], q_ids))
        q_ids, first = np.unique(q_ids[order], return_index=True)
        asked = q_ids, q[order[first]], q_label[order[first]]
        # positives: one window of any score per anchor
        any_ = np.full(len(q_ids), LOWEST)
        shared = spark.sparkContext.broadcast((*asked, *_bounded(longest, asked, np.arange(len(q_ids)), any_, -any_, positives, True)))
        held = _pass(index, width, shared, positives, True).toArrow()  # at most ``positives`` rows per anchor of the block
        shared.destroy()
        score, positive = held.column("score").to_numpy(), held.column("vec_id").to_numpy()
        owner = np.searchsorted(q_ids, held.column("anchor_id").to_numpy())
        order = np.argsort(owner, kind="stable")
        owner, score, positive = owner[order], score[order], positive[order]
        bounded = _bounded(longest, asked, owner, *limits(score, low, high), negatives, False)
        shared = spark.sparkContext.broadcast((*asked, *bounded, positive, score))
        _named(_pass(index, width, shared, negatives, False), shared).write.mode("append").parquet(best)
        shared.destroy()
    return spark.read.schema(RESULT).parquet(best)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _by_anchor(owner: np.ndarray, n: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """STEP anchors at a time: their slice, that of their windows (sorted by anchor), and the windows' anchors in it."""
    for a in range(0, n, STEP):
        s, e = np.searchsorted(owner, [a, a + STEP])
        yield slice(a, a + STEP), slice(s, e), owner[s:e] - a


def _bounded(rows: tuple, asked: tuple, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple:
    """Windows with a first bound: the k-th score that ``rows`` give them."""
    need = low.copy()
    for at, own, anchors in _by_anchor(owner, len(asked[0])):
        w = Windows(low[own], high[own], low[own], k)
        search(*rows, *(c[at] for c in asked), anchors, w, same)
        need[own] = w.need
    return owner, low, high, need


def _pass(index: DataFrame, width: int, shared: Broadcast, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows per window over the whole index, for one block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *asked, owner, low, high, need = shared.value[:7]
        parts = [(at, own, anchors, Windows(low[own], high[own], need[own], k)) for at, own, anchors in _by_anchor(owner, len(asked[0]))]
        for b in batches:
            for s in range(0, b.num_rows, 8 * BUCKET):
                t = b.slice(s, 8 * BUCKET)
                rows = t.column("vec_id").to_numpy(), matrix(t.column("v"), width), t.column("label").to_numpy()
                for at, _, anchors, w in parts:
                    search(*rows, *(c[at] for c in asked), anchors, w, same)
        for _, own, _, w in parts:
            at, near, score = w.found()
            if len(at):
                window = own.start + at
                yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(asked[0][owner[window]]), pa.array(near), pa.array(score)], ["window", "anchor_id", "vec_id", "score"])

    found = index.mapInArrow(run, "window long, anchor_id long, vec_id long, score long")
    rank = Window.partitionBy("window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _named(found: DataFrame, shared: Broadcast) -> DataFrame:
    """Windows by their anchor and positive."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positive, score = shared.value[7:]
        for b in batches:
            window = b.column("window").to_numpy()
            columns = [b.column("anchor_id"), pa.array(positive[window]), b.column("rank"), b.column("vec_id"), pa.array(score[window]), b.column("score")]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return found.mapInArrow(name, RESULT)


def op12_query(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of whole ``embeddings``; rows without label, vec_id or a vector of finite components take no part."""
    return mine(labelled(embeddings))
