"""Models as protocol buffer messages: one tree per root token, or the whole set.

Characters of a model over strings are written as the numbers of their code
points.  Trees are packed from rows in pre-order, so a task holds the bytes of
nodes that are finished and the few that are open, never rows or objects of a
whole tree; and each is packed in parts, one for each token before the root,
which are then joined as bytes.  A tree is one value (or one file, see
``sources.token_files``); models of any size are kept as Parquet.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions import wire
from gramlake.operators.prefixes import prefixes
from gramlake.sources.scratch import written

#: Rows of a model that is put into one message on the driver.
HELD_ROWS = 1_000_000
#: Trees that are merged at once, about.
FAN = 8
#: Rows of messages.
ROWS = "k int, prefix array<int>, successor int, n long"


def _numbered(node: DataFrame) -> DataFrame:
    """``k, prefix (array), successor, n`` with tokens as numbers."""
    if prefixes(node).tokens:
        return node.select("k", F.col("prefix").cast("array<long>").alias("prefix"), F.col("successor").cast("long").alias("successor"), "n")
    codes = F.transform(F.filter(F.split("prefix", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return node.select("k", codes.alias("prefix"), F.ascii("successor").cast("long").alias("successor"), "n")


class Packer:
    """Packs the nodes of a subtree that come in pre-order; ``depth`` is that of its first node."""

    def __init__(self, depth: int):
        self.depth, self.path, self.open, self.done = depth, [], [], b""

    def add(self, path: list[int], successor: int, n: int) -> None:
        if path != self.path:
            same = next((i for i, (a, b) in enumerate(zip(path, self.path)) if a != b), min(len(path), len(self.path)))
            self._close(same)
            self.open += [(t, [], bytearray()) for t in path[same:]]
            self.path = path
        counts = self.open[-1][1]
        if counts and counts[-1][0] == successor:
            n += counts.pop()[1]
        counts.append((successor, n))

    def _close(self, keep: int) -> None:
        while len(self.open) > keep:
            token, counts, below = self.open.pop()
            data = wire.node_head(token, self.depth + len(self.open), counts) + below
            if self.open:
                self.open[-1][2].extend(wire.framed(wire.BELOW, data))
            else:
                self.done = data

    def close(self) -> bytes:
        self._close(0)
        self.path = []
        return self.done


def tree_parts(node: DataFrame) -> DataFrame:
    """``token, second, part``: the bytes of every tree in parts, in the order of (token, second).

    The part without ``second`` is the root's own head; each other part is the
    tree of one token before the root, ready to be appended.
    """
    rows = _numbered(node).where("k > 0").select(F.reverse("prefix").alias("path"), "successor", "n")
    rows = rows.select(F.element_at("path", 1).alias("token"), F.get("path", F.lit(1)).alias("second"), "path", "successor", "n")
    names = ["token", "second", "part"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> pa.RecordBatch:
            token, second = key
            data = wire.framed(wire.BELOW, packer.close()) if second is not None else packer.close()
            return pa.RecordBatch.from_arrays([pa.array([token]), pa.array([second], pa.int64()), pa.array([data], pa.binary())], names)

        key, packer = None, None
        for b in batches:
            for token, second, path, successor, n in zip(*(b.column(c).to_pylist() for c in ("token", "second", "path", "successor", "n"))):
                if (token, second) != key:
                    if packer:
                        yield finished()
                    key, packer = (token, second), Packer(0 if second is None else 1)
                packer.add(path if second is None else path[1:], successor, n)
        if packer:
            yield finished()

    dealt = rows.repartition("token", "second").sortWithinPartitions("token", "second", "path", "successor")
    return dealt.mapInArrow(pack, "token long, second long, part binary")


def joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Per token the bytes of its tree in pieces; rows are sorted by (token, second).  One part is held at a time."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("token", "second", "part"))))
    held = next(rows, None)

    def pieces(token: int) -> Iterator[bytes]:
        nonlocal held
        if held[1] is not None:  # the root follows nothing by itself
            yield wire.node_head(token, 0, [])
        while held is not None and held[0] == token:
            part, held = held[2], next(rows, None)
            yield part

    while held is not None:
        token = held[0]
        yield token, pieces(token)


def serialized_trees(node: DataFrame, compress: bool = True) -> DataFrame:
    """``token, tree (binary)`` per root token."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, pieces in joined_parts(batches):
            data = b"".join(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([token]), pa.array([wire.zipped(data) if compress else data], pa.binary())], ["token", "tree"])

    return tree_parts(node).repartition("token").sortWithinPartitions("token", "second").mapInArrow(build, "token long, tree binary")


def merged_trees(trees: DataFrame, compressed: bool = True, fan: int = FAN) -> DataFrame:
    """``token, tree``: of all trees of a token one, with the counts of all.

    Messages are merged as they are, without rows.  The trees of a token are
    merged in levels of about ``fan`` at a time, so those of a common token are
    read by many tasks; null trees are left out.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> pa.RecordBatch:
            data = wire.merged_trees(held)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([wire.zipped(data) if compressed else data], pa.binary())], ["token", "tree"])

        key, held = None, []
        for b in batches:
            for token, slot, tree in zip(*(b.column(c).to_pylist() for c in ("token", "slot", "tree"))):
                if (token, slot) != key:
                    if held:
                        yield finished()
                    key, held = (token, slot), []
                held.append(wire.unzipped(tree) if compressed else tree)
        if held:
            yield finished()

    now = trees.select(F.col("token").cast("long").alias("token"), "tree").where("token is not null and tree is not null")
    while True:
        now = written(now.withColumn("place", F.monotonically_increasing_id()), "merged-trees")
        slots = now.groupBy("token").agg(F.ceil(F.count("*") / fan).cast("long").alias("slots"), F.count("*").alias("trees"))
        slots = written(slots, "merged-slots")
        most = slots.agg(F.max("trees")).first()[0] or 0
        if most <= 1:
            return now.select("token", "tree")
        dealt = now.join(slots, "token").withColumn("slot", F.pmod(F.xxhash64("place"), F.col("slots")))
        now = dealt.select("token", "slot", "tree").repartition("token", "slot").sortWithinPartitions("token", "slot").mapInArrow(merge, "token long, tree binary")


def tree_rows(trees: DataFrame, compressed: bool = True, column: str = "tree") -> DataFrame:
    """``k, prefix (array<int>), successor, n`` of serialized trees; bytes that are none raise."""

    def rows(data: bytes) -> Iterator[tuple]:
        return ((len(p), p, s, n) for p, s, n in wire.tree_rows(wire.unzipped(data) if compressed else data))

    return _unpacked(trees, column, rows, ROWS)


def _unpacked(messages: DataFrame, column: str, rows: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of messages, some tens of thousands at a time."""
    kinds = messages.sparkSession.createDataFrame([], schema).toArrow().schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = (row for data in b.column(column).to_pylist() if data is not None for row in rows(data))
            while held := list(itertools.islice(made, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], kinds.names)

    return messages.select(column).mapInArrow(read, schema)


def set_messages(node: DataFrame, compress: bool = True) -> DataFrame:
    """``message (binary)``: a model as messages that are one when their bytes are put one after the other.

    One holds the unigram counts, size and depth, each other one a root's tree;
    every row is a message of a set by itself, so no task has them all.
    """
    rows = _numbered(node)
    facts = rows.agg(F.count_distinct(F.when(F.col("k") > 0, F.element_at("prefix", -1))).alias("size"), F.coalesce(F.max("k"), F.lit(0)).alias("depth"), F.sort_array(F.collect_list(F.when(F.col("k") == 0, F.struct("successor", "n")))).alias("counts"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for size, depth, counts in zip(*(b.column(c).to_pylist() for c in ("size", "depth", "counts"))):
                sampler = wire.sampler_message({c["successor"]: c["n"] for c in counts})
                made.append(wire.pack("SuffixTreeSet", {"size": size, "depth": depth, "sampler": sampler}))
            yield pa.RecordBatch.from_arrays([pa.array([wire.zipped(m) if compress else m for m in made], pa.binary())], ["message"])

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [wire.framed(wire.BELOW, t) for t in b.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([wire.zipped(m) if compress else m for m in made], pa.binary())], ["message"])

    return facts.mapInArrow(head, "message binary").union(serialized_trees(node, compress=False).mapInArrow(tree, "message binary"))


def set_rows(messages: DataFrame, compressed: bool = True, column: str = "message") -> DataFrame:
    """``k, prefix (array<int>), successor, n`` of messages of sets, whole ones or parts."""

    def rows(data: bytes) -> Iterator[tuple]:
        data = wire.unzipped(data) if compressed else data
        _, _, counts, below = wire.tree_parts(data)
        yield from ((0, [], s, n) for s, n in counts.items())
        yield from ((len(p), p, s, n) for a, b in below for p, s, n in wire.tree_rows(data, a, b))

    return _unpacked(messages, column, rows, ROWS)


def sampler_messages(node: DataFrame) -> DataFrame:
    """``k, prefix, message (binary)``: the counts of every prefix as a message of a sampler; tokens as numbers."""
    per = _numbered(node).groupBy("k", "prefix").agg(F.collect_list(F.struct("successor", "n")).alias("counts"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [wire.pack("Sampler", wire.sampler_message({c["successor"]: c["n"] for c in counts})) for counts in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("prefix"), pa.array(made, pa.binary())], ["k", "prefix", "message"])

    return per.mapInArrow(pack, "k int, prefix array<long>, message binary")


def sampler_rows(messages: DataFrame) -> DataFrame:
    """The counts of ``sampler_messages``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(k, p, s, n) for k, p, m in zip(*(b.column(c).to_pylist() for c in ("k", "prefix", "message"))) for s, n in wire.sampler_counts(wire.unpack("Sampler", m)).items()]
            columns = zip(*made) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()))], ["k", "prefix", "successor", "n"])

    return messages.mapInArrow(read, "k int, prefix array<long>, successor long, n long")


def model_bytes(node: DataFrame, compress: bool = True) -> bytes:
    """The whole model as one message; its rows are counted first."""
    if node.count() > HELD_ROWS:
        raise ValueError(f"the model has over {HELD_ROWS} rows; use serialized_trees()")
    rows = _numbered(node)
    counts = {r["successor"]: r["n"] for r in rows.where("k = 0").select("successor", "n").collect()}
    depth = rows.agg(F.max("k")).first()[0] or 0
    trees = [bytes(r["tree"]) for r in serialized_trees(node, compress=False).orderBy("token").collect()]
    data = wire.pack("SuffixTreeSet", {"size": len(trees), "depth": depth, "sampler": wire.sampler_message(counts)}) + b"".join(wire.framed(wire.BELOW, t) for t in trees)
    return wire.zipped(data) if compress else data


def model_from_bytes(spark: SparkSession, data: bytes, compressed: bool = True, characters: bool = False) -> DataFrame:
    """The ``node`` relation of a message; numbers become characters again if ``characters``."""
    data = wire.unzipped(data) if compressed else data
    _, _, counts, below = wire.tree_parts(data)
    rows = [(0, [], s, n) for s, n in counts.items()]
    rows += [(len(p), p, s, n) for a, b in below for p, s, n in wire.tree_rows(data, a, b)]
    if characters:
        return spark.createDataFrame([(k, "".join(map(chr, p)), chr(s), n) for k, p, s, n in rows], "k int, prefix string, successor string, n long")
    return spark.createDataFrame(rows, "k int, prefix array<int>, successor int, n long")
