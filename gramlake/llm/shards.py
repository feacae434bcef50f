"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: the shard is a consistent (jump)
hash of doc_id, so one more shard takes rows only into itself, and within a
shard a second hash (of doc_id and text) picks one of several buckets that
each fit in memory, however many rows share a doc_id or have none; rows that
are alike in all columns, if they are that many, are numbered and hashed by
their number too.
Pass two takes a bucket at a time, puts it in Fisher-Yates order under a seed
of its own and writes it.  Counts per bucket, from ids alone, give each bucket
its first slot, so slots are gapless without any task seeing a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import free_name, groups, scratch_path, written

SHARDS, SEED = 40, 20_240_501
#: Bytes of a bucket, about.
BUCKET_BYTES = 16_000_000


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def jump_shard(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """Consistent hash: at each further shard a row stays or moves to the new one.

    Row moves to shard n (n = 1, 2, ...) if its n-th hash falls in the first
    1 / (n + 1) of the hash range; its shard is the last one it moved to.
    """
    moved = F.filter(F.sequence(F.lit(1), F.lit(max(shards - 1, 1))), lambda n: (n < shards) & (F.pmod(F.xxhash64(doc_id, n, F.lit(seed)), (n + 1).cast("long")) == 0))
    return F.coalesce(F.array_max(moved), F.lit(0)).cast("int")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """Positions 0..n-1 in random order: each place swaps with one not yet passed."""
    order = list(range(n))
    picks = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(picks[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def bucket_count(total: int, shards: int) -> int:
    """Buckets of a shard, for that many bytes in all shards."""
    return max(1, -(-total // (shards * BUCKET_BYTES)))


def numbered_repeats(docs: DataFrame, copy: str) -> DataFrame:
    """``docs`` with a column ``copy``: 0, or from 1 on for the rows of a (doc_id, text) that alone would fill a bucket.

    Such rows are grouped by all their columns and numbered by their counts, so
    that none needs a place of its own in the input; columns are of types that
    can be grouped (no maps).
    """
    key = free_name(docs, "__shard_same")
    hashed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    sizes = hashed.groupBy(key).agg(F.sum(record_size(F.col("text").cast("string"))).alias("bytes"), F.count("*").alias("n"))
    hot = written(sizes.where((F.col("bytes") > BUCKET_BYTES) & (F.col("n") > 1)).select(key), "shard-repeats")
    rest = hashed.join(hot, key, "left_anti").drop(key).withColumn(copy, F.lit(0).cast("long"))
    many = hashed.join(hot, key, "left_semi").drop(key)
    n = free_name(many, "__shard_n")
    counted = many.groupBy(*[many[c] for c in many.columns]).agg(F.count("*").alias(n))
    return rest.unionByName(counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n))


def shuffle_to_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write all columns of ``docs`` with ``shard, grown_shard, slot`` as Parquet below ``folder``.

    Returns what is in the files.  Null texts and null doc_ids are records
    like any other (null ids share a shard); rows that repeat a doc_id go to
    its shard together, but to many of its buckets; equal texts of different
    ids are dealt apart; an empty table writes no rows.  The number of buckets
    follows from the bytes of the table alone, so the order is the same on any
    cluster and for any partitioning.  The columns ``shard, grown_shard,
    slot`` of the input are replaced.
    """
    docs = docs.drop("shard", "grown_shard", "slot")
    in_bucket, number, first, at, key, copy = (free_name(docs, "__shard_" + x) for x in ("bucket", "number", "first", "at", "key", "copy"))
    names = docs.columns
    spark = docs.sparkSession
    total, = docs.agg(F.sum(record_size(F.col("text").cast("string")))).first()
    buckets = bucket_count(int(total or 0), shards)
    docs = numbered_repeats(docs, copy)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    own = F.when(F.col(copy) == 0, F.xxhash64(doc_id, text, F.lit(seed + 1))).otherwise(F.xxhash64(doc_id, F.col(copy), F.lit(seed + 1)))
    placed = {"shard": jump_shard(doc_id, shards, seed), in_bucket: F.pmod(own, F.lit(buckets)).cast("int")}
    counts = docs.select(*[c.alias(n) for n, c in placed.items()]).groupBy("shard", in_bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.select("shard", in_bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias(first)), "shard-firsts")
    scattered = docs.withColumns(placed | {"grown_shard": jump_shard(doc_id, shards + 1, seed)}).drop(copy)
    scattered = scattered.withColumn(key, F.coalesce(doc_id, F.lit(-(2**63))))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["shard", in_bucket]):
            t = t.combine_chunks()
            shard, bucket = t.column("shard")[0].as_py(), t.column(in_bucket)[0].as_py()
            # arrival order differs between runs; doc_id (then the text) does not
            keys = [(key, "ascending")] + ([("text", "ascending")] if "text" in names and pa.types.is_string(t.schema.field("text").type) else [])
            by_id = pa.compute.sort_indices(t, sort_keys=keys).to_numpy()
            order = by_id[fisher_yates(t.num_rows, (seed * 1_000_003 + shard * 65_537 + bucket) % 2**63)]
            out = t.take(pa.array(order)).drop_columns([key]).append_column(at, pa.array(np.arange(t.num_rows)))
            yield from out.to_batches(max_chunksize=2000)

    schema = scattered.drop(key).withColumn(at, F.lit(0).cast("long")).schema
    spread = scattered.repartition(F.col("shard"), F.col(in_bucket)).sortWithinPartitions("shard", in_bucket)
    mixed = spread.mapInArrow(shuffle, schema)
    mixed = mixed.join(firsts, ["shard", in_bucket]).withColumn("slot", F.col(first) + F.col(at))
    mixed.select(*names, "grown_shard", "slot", F.col("shard").alias(number)).write.partitionBy(number).parquet(folder)
    out = mixed.select(*names, "grown_shard", "slot", F.col("shard").cast("int").alias(number))
    return spark.read.schema(out.schema).parquet(folder).withColumnRenamed(number, "shard")


def op9_query(docs: DataFrame) -> DataFrame:
    """Shard and slot of every row of ``documents`` as the written files hold them; cases as in ``shuffle_to_shards``."""
    docs = docs.select("doc_id", "text")
    out = shuffle_to_shards(docs, scratch_path(docs.sparkSession, "shards"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return out.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
