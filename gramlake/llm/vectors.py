"""Exact top-k search by pivot distances, and embedding near-dedup by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import groups, scratch_path, written
from gramlake.llm.components import Forest, connected_components


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as doubles, short ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = max([*sizes.tolist(), 0]) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    ends = np.cumsum(sizes)
    for i, (n, e) in enumerate(zip(sizes, ends)):
        out[i, :n] = flat[e - n : e]
    return out


# --- exact top-k ---------------------------------------------------------------------------------

#: Rows of the bounded sample that pivots are chosen from and first bounds are taken from.
PIVOT_SAMPLE = 4096
PIVOTS = 32
#: Queries that go over the index at once; their packed vectors are all that is sent to executors.
QUERY_BLOCK = 16_384
#: Rows of an annulus.
ANNULUS = 512
#: Stands for "no score"; every score of two vectors is above it.
LOWEST = -(2**63 - 1)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the sample; fewer pivots if it has fewer distinct rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def whole_vectors(df: DataFrame, scale: float = 256.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every usable vector, x as double; and the columns to ``carry``."""
    rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"), *carry).where(F.col("vec_id").isNotNull() & finite(F.col("e")))
    # Spark's floor gives a long; doubles from 2**53 on are whole as they are
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)
    return rows.select("vec_id", F.transform("e", lambda x: whole(x * F.lit(scale))).alias("v"), *carry)


def exact_scores(q: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as longs (LOWEST where ``own``); one that is no long is an error.

    No partial sum exceeds the product of the norms, so doubles are exact up
    to 2**53 and longs below 2**63; beyond that Python's integers are used.
    """
    out = q @ x.T
    top = np.sqrt((q**2).sum(1).max(initial=0)) * np.sqrt((x**2).sum(1)) * (1 + 1e-9)
    if top.max(initial=0) <= 2.0**53:
        return np.where(own, LOWEST, out.astype(np.int64))
    wide, huge = np.flatnonzero((top > 2.0**53) & (top < 2.0**63)), np.flatnonzero(top >= 2.0**63)
    out[:, top > 2.0**53] = 0
    out = out.astype(np.int64)
    if len(wide):
        out[:, wide] = q.astype(np.int64) @ x[wide].astype(np.int64).T
    if len(huge):
        whole = np.frompyfunc(int, 1, 1)
        scores = np.where(own[:, huge], 0, whole(q) @ whole(x[huge]).T)
        if scores.max() > -LOWEST or scores.min() <= LOWEST:
            raise OverflowError("a score does not fit a long")
        out[:, huge] = scores.astype(np.int64)
    return np.where(own, LOWEST, out)


def search_annuli(ids: np.ndarray, x: np.ndarray, cell: np.ndarray, dist: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_dist: np.ndarray, floor_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best k rows of this part of the index for every query.

    Rows are sorted by (cell, dist).  For a row x of a cell with pivot p,
    |d(q,p) - d(x,p)| <= d(q,x), so q.x <= (|q|^2 + |x|^2 - gap^2) / 2 bounds
    all of an annulus at once.  Annuli are expanded from the most promising
    outward; a query leaves when no later bound reaches its k-th score (at
    first ``floor_``, a score it is known to reach).  Returns query positions,
    row ids, scores and the number of (query, row) scores computed.
    """
    edges = np.unique(np.r_[0, np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(ids), ANNULUS), len(ids)])
    a, b = edges[:-1], edges[1:]
    low, high = dist[a], dist[b - 1]
    norm = np.maximum.reduceat((x**2).sum(1), a)
    own = q_dist[:, cell[a]]
    squares = (q**2).sum(1)[:, None] + norm[None]
    # beyond 2**53 squares are rounded, so the slack grows with them
    gap = np.maximum(0, np.maximum(low[None] - own, own - high[None]) - 1e-6 * (1 + own + np.where(squares > 2.0**51, np.sqrt(squares), 0)))
    bound = (squares - gap**2) / 2 + 1e-3 + 1e-9 * np.where(squares > 2.0**51, squares, 0)
    best_s = np.full((len(q), k), LOWEST)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    need = np.maximum(np.maximum(floor_, LOWEST).astype(np.int64), LOWEST)
    work = 0
    for m in np.argsort(-bound.max(0)):
        open_ = np.flatnonzero(bound[:, m] >= need)
        if not len(open_):
            continue
        work += len(open_) * int(b[m] - a[m])
        scores = exact_scores(q[open_], x[a[m] : b[m]], q_ids[open_][:, None] == ids[None, a[m] : b[m]])
        hit = scores.max(1) >= need[open_]
        open_, scores = open_[hit], scores[hit]
        if not len(open_):
            continue
        every_s = np.concatenate([best_s[open_], scores], 1)
        every_i = np.concatenate([best_i[open_], np.broadcast_to(ids[a[m] : b[m]], scores.shape)], 1)
        order = np.lexsort((every_i, -every_s), axis=1)[:, :k]
        best_s[open_] = np.take_along_axis(every_s, order, 1)
        best_i[open_] = np.take_along_axis(every_i, order, 1)
        need[open_] = np.maximum(need[open_], best_s[open_, -1])
    at, rank = np.nonzero((best_s >= need[:, None]) & (best_s > LOWEST))
    return at, best_i[at, rank], best_s[at, rank], work


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row whose vec_id is divisible by ``every``.

    ``vectors`` has ``vec_id, v`` (whole numbers as doubles).  Rows are dealt
    by range over (nearest pivot, distance, vec_id), so a pivot with a third of
    all rows is cut into as many parts as it needs.  Queries go over the parts
    in blocks of bounded size; each part returns its k best at most, and these
    are ranked per query.  Ties go to the smaller vec_id; rows with the
    query's own vec_id are no candidates; a repeated query id is one query
    (its smallest vector, compared component by component); shorter vectors count as padded with zeros; no rows
    give no rows.
    """
    vectors = written(vectors, "topk-vectors")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(int(width or 0), 1)
    part = min(1.0, 2 * PIVOT_SAMPLE / max(n, 1))
    rows = vectors.where((F.xxhash64("vec_id") % 1_000_000 + 1_000_000) % 1_000_000 < int(part * 1_000_000) + 1).limit(PIVOT_SAMPLE).toArrow()
    s_ids, sample = rows.column("vec_id").to_numpy(), matrix(rows.column("v"), width)
    pivots = choose_pivots(sample, PIVOTS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(matrix(b.column("v"), width), pivots)
            near = d.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(d[np.arange(len(near)), near])], ["vec_id", "v", "cell", "dist"])

    parts = max(1, -(-int(n) // 20_000), vectors.sparkSession.sparkContext.defaultParallelism)
    index = vectors.mapInArrow(key, "vec_id long, v array<double>, cell int, dist double")
    index = written(index.repartitionByRange(parts, "cell", "dist", "vec_id").sortWithinPartitions("cell", "dist", "vec_id"), "topk-index")
    queries = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(blocks, "block"), "topk-queries")
    found = scratch_path(vectors.sparkSession, "topk-found")
    for block in range(blocks):
        got = queries.where(F.col("block") == block).toArrow()
        q_ids, q = got.column("vec_id").to_numpy(), matrix(got.column("v"), width)
        order = np.lexsort((*q.T[::-1], q_ids))
        q_ids, first = np.unique(q_ids[order], return_index=True)
        q = q[order[first]]
        seen = exact_scores(q, sample, q_ids[:, None] == s_ids[None]) if len(sample) else np.zeros((len(q), 0), dtype=np.int64)
        floor_ = -np.sort(-seen, axis=1)[:, k - 1] if seen.shape[1] >= k else np.full(len(q), LOWEST)
        # a block is done and let go before the next one comes to the driver
        shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q, floor_, pivots))
        _pass(index, width, shared, k).write.mode("append").parquet(found)
        shared.destroy()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = vectors.sparkSession.read.schema("query_id long, vec_id long, score long").parquet(found)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(index: DataFrame, width: int, shared: Broadcast, k: int) -> DataFrame:
    """The best of each part of the index for one block of queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, floor_, pivots = shared.value
        q_dist = distances(q, pivots)
        floor_ = floor_.copy()
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("vec_id").to_numpy(), matrix(b.column("v"), width)
            cell, dist = b.column("cell").to_numpy(), b.column("dist").to_numpy()
            order = np.lexsort((ids, dist, cell))
            for s in range(0, len(q), 1024):
                at, near, score, _ = search_annuli(ids[order], x[order], cell[order], dist[order], q_ids[s : s + 1024], q[s : s + 1024], q_dist[s : s + 1024], floor_[s : s + 1024], k)
                if len(at):
                    # k scores in one batch raise the bound for those that follow
                    count = np.bincount(at, minlength=len(q[s : s + 1024]))
                    worst = np.full(len(count), -LOWEST)
                    np.minimum.at(worst, at, score)
                    full = np.flatnonzero(count >= k)
                    floor_[s + full] = np.maximum(floor_[s + full], worst[full])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[s + at]), pa.array(near), pa.array(score)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(search, "query_id long, vec_id long, score long")


def op1_query(embeddings: DataFrame) -> DataFrame:
    """The best five of all rows for each query row; cases as in ``whole_vectors`` and ``top_k``."""
    return top_k(whole_vectors(embeddings))


# --- near-dedup ----------------------------------------------------------------------------------

#: Members of a bucket that one task compares; larger buckets are dealt as pairs of chunks.
CHUNK = 2048


def setting(n: int, width: int) -> tuple[int, int, int]:
    """Tables, hashes of a table, and probes beside the home bucket, for ``n`` vectors.

    A table has (2 * width) ** hashes buckets, so hashes grow with the
    logarithm of n and unlike vectors seldom meet; tables and probes grow with
    the hashes, which holds the share of found pairs of cosine 0.98 at 0.99 or
    more (``tests/llm`` measure it for all settings up to five hashes).
    """
    axes = 2 * (1 << max(1, (max(width, 1) - 1).bit_length()))
    hashes = min(8, max(2, int(np.ceil(np.log(8.0 * max(n, 1)) / np.log(axes)))))
    return max(3, hashes), hashes, max(3, 2 * hashes - 3)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (width a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / x.dtype.type(np.sqrt(d))


def bucket_keys(x: np.ndarray, labels: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """(rows, tables * (1 + probes)) bucket numbers, those of a table side by side.

    A hash is the signed axis nearest to the vector after three rounds of sign
    flips and Hadamard transforms.  Probes replace the axis whose runner-up is
    closest to it, as the vector's neighbours most likely differ there.
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width), dtype=np.float32)
    padded[:, :d] = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables * (1 + probes)), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axes, loss = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice(np.array([-1, 1], dtype=np.float32), width))
            size = np.abs(y)
            top = np.argpartition(-size, 1 + (width > 2), axis=1)[:, : 2 + (width > 2)]
            order = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
            top = np.take_along_axis(top, order, 1)
            best = np.take_along_axis(size, top, 1)
            axes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            loss.append(best[:, :1] - best[:, 1:])
        home = np.stack([a[:, 0] for a in axes], 1)
        choices = np.concatenate(loss, 1)  # (n, hashes * runner-ups)
        order = np.argsort(choices, axis=1, kind="stable")[:, :probes]
        per = loss[0].shape[1]
        for p in range(1 + probes):
            now = home.copy()
            if p:
                which = order[:, min(p - 1, order.shape[1] - 1)]
                for h in range(hashes):
                    own = which // per == h
                    now[own, h] = axes[h][rows[own], 1 + which[own] % per]
            key = np.full(n, t, dtype=np.int64)
            for h in range(hashes):
                key = key * (2 * width) + now[:, h]
            out[:, t * (1 + probes) + p] = key * 1_000_003 + labels
    return out


def near_pairs(x: np.ndarray, side: np.ndarray | None, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members with at least that cosine, or pairs across both sides where ``side`` is given."""
    top = np.abs(x).max(1, initial=0)
    if len(x) and (top.max() > 1e140 or top.min() < 1e-140):  # their squares are no doubles
        x = x / top[:, None]
    unit = np.sqrt((x**2).sum(1))
    rows_ = np.arange(len(x)) if side is None else np.flatnonzero(side == 0)
    columns = rows_ if side is None else np.flatnonzero(side == 1)
    step = max(1, 2_000_000 // max(1, len(columns)))
    for a in range(0, len(rows_), step):
        rows = rows_[a : a + step]
        near = (x[rows] @ x[columns].T) / (unit[rows][:, None] * unit[columns][None]) >= at_least
        if side is None:
            near &= rows[:, None] < columns[None]
        i, j = np.nonzero(near)
        for s in range(0, len(i), 200_000):
            yield rows[i[s : s + 200_000]], columns[j[s : s + 200_000]]


def met_before(p: np.ndarray, q: np.ndarray, key: int, per_table: int) -> np.ndarray:
    """Pairs (rows of bucket numbers ``p`` and ``q``) that share a bucket of a smaller number than ``key``.

    Such a pair is left to that bucket, so no link counts twice.
    """
    out = np.zeros(len(p), dtype=bool)
    for c in range(p.shape[1]):
        table = c // per_table * per_table
        for o in range(table, table + per_table):
            out |= (p[:, c] == q[:, o]) & (p[:, c] < key)
    return out


def bundles(parts: Iterator[pa.Table], rows: int = 4096) -> Iterator[tuple[pa.Table, list[int]]]:
    """Groups of two rows or more put together up to about ``rows``, and where each begins."""
    held, starts = [], [0]
    for t in parts:
        if t.num_rows > 1:
            held.append(t)
            starts.append(starts[-1] + t.num_rows)
            if starts[-1] >= rows:
                yield pa.concat_tables(held), starts
                held, starts = [], [0]
    if held:
        yield pa.concat_tables(held), starts


def alike(a: int, b: int, *columns: np.ndarray) -> list[np.ndarray]:
    """Positions a..b by equal values (bucket numbers may collide across labels and widths)."""
    own = np.arange(a, b)
    if all((c[a:b] == c[a]).all() for c in columns):
        return [own]
    _, which = np.unique(np.stack([c[a:b] for c in columns], 1), axis=0, return_inverse=True)
    return [own[which.ravel() == w] for w in range(which.max() + 1)]


def near_duplicates(vectors: DataFrame, at_least: float = 0.98, chosen: tuple[int, int, int] | None = None) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Only vectors with equal, non-null labels are compared, by cosine in double
    precision.  Rows whose vector or label is null, whose vector is zero or
    holds a null or non-finite component, or whose vec_id is null, link with
    nothing (component_id is their vec_id).  A row is a vector of its own, also
    where rows share a vec_id: n_links counts the other rows linked to it, and
    a repeated row is linked to its repetition.  component_id is the smallest
    vec_id of the rows reachable.  Equal vectors of a label are one class until
    the links are counted.  Candidates come from multiprobe buckets (``chosen``
    overrides ``setting``); every reported link is verified.  An empty table
    gives no rows; other columns are ignored.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("e"), F.col("label").cast("long"))
    usable = finite(F.col("e")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("e", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    good, rest = rows.where(usable), rows.where(~usable)
    classes = good.groupBy("label", "e").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "neardup-classes")
    n_classes, longest = classes.agg(F.count("*"), F.max(F.size("e"))).first()
    tables, hashes, probes = chosen or setting(n_classes, longest or 1)
    per = 1 + probes

    def keys_of(x: np.ndarray, size: np.ndarray, label: np.ndarray) -> np.ndarray:
        keys = np.empty((len(x), tables * per), dtype=np.int64)
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            keys[own] = bucket_keys(x[own, :d], label[own], tables, hashes, probes)
        return keys

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sub in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                keys = np.sort(keys_of(matrix(sub.column("e")), np.diff(sub.column("e").offsets.to_numpy()), sub.column("label").to_numpy()), axis=1)
                new = np.c_[np.ones(len(keys), dtype=bool), keys[:, 1:] != keys[:, :-1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sub.column("rep").to_numpy(), new.sum(1))), pa.array(keys[new])], ["rep", "key"])

    dealt = written(classes.select("rep", "label", "e").mapInArrow(deal, "rep long, key long"), "neardup-keys")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    dealt = dealt.join(sizes, "key").withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("rep", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    full = dealt.join(classes, "rep").select("key", "i", "j", "side", "rep", "n", "label", "e")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in bundles(groups(batches, ["key", "i", "j"])):
            e = t.column("e").combine_chunks()
            rep, n, label, side, key = (t.column(c).to_numpy() for c in ("rep", "n", "label", "side", "key"))
            across = t.column("i").to_numpy() != t.column("j").to_numpy()
            size, x = np.diff(e.offsets.to_numpy()), matrix(e)
            # most buckets hold no link at all; bucket numbers are needed for the members of links only
            keys, known = np.empty((len(rep), tables * per), dtype=np.int64), np.zeros(len(rep), dtype=bool)
            links, forest = np.zeros(len(rep), dtype=np.int64), Forest(len(rep))
            for a, b in zip(starts, starts[1:]):
                for own in alike(a, b, label, size):
                    for p, q in near_pairs(x[own], side[own] if across[a] else None, at_least) if len(own) > 1 else ():
                        p, q = own[p], own[q]
                        new = np.unique(np.r_[p, q])
                        new = new[~known[new]]
                        if len(new):
                            keys[new], known[new] = keys_of(x[new], size[new], label[new]), True
                        ours = ~met_before(keys[p], keys[q], int(key[a]), per)
                        p, q = p[ours], q[ours]
                        links += np.bincount(p, n[q], len(rep)).astype(np.int64) + np.bincount(q, n[p], len(rep)).astype(np.int64)
                        forest.add(p, q)
            low, hit = forest.labels(), np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[low[hit]])], ["rep", "links", "joined"])

    spread = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = written(spread.mapInArrow(compare, "rep long, links long, joined long"), "neardup-links")
    roots = connected_components(found.select(F.col("rep").alias("u"), F.col("joined").alias("v")))
    light = classes.select("rep", "first_id", "n").join(roots, F.col("rep") == roots.node, "left").select("rep", "first_id", "n", F.coalesce("root", "rep").alias("root"))
    light = light.join(light.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    counted = written(light.select("rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "neardup-found")
    named = good.join(classes.select("label", "e", "rep"), ["label", "e"]).join(counted, "rep").select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_query(embeddings: DataFrame) -> DataFrame:
    """Links and components of whole ``embeddings``; cases as in ``near_duplicates``."""
    return near_duplicates(embeddings)
