"""Models as tables for look-ups: one row per prefix, bucketed and pruned.

A row holds all that is known of a prefix: its total, its successors in order,
their counts, and an alias table, by which a draw takes two look-ups whatever
the number of successors.  Rows are partitioned by (a hash of) the token that
the prefix ends in and bucketed by the prefix: a look-up joins the exploded
suffixes of the queries to the buckets, so only queries are shuffled, and reads
the partitions of the queries' last tokens alone.  The empty prefix, which
every query may fall back on, is one row and is sent to all tasks (its size is
bounded by the vocabulary).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gramlake.operators.prefixes import prefixes

#: Directories of a stored model, and its buckets by default.
PARTS, BUCKETS = 64, 64


def alias_table(counts: list[int]) -> tuple[list[int], list[int]]:
    """Cuts and aliases of weights: every slot holds ``sum(counts)`` units.

    A uniform slot i and a uniform unit below the sum give i where the unit is
    below cut i, and alias i otherwise, with exactly the counts' probabilities:
    weights are counts times the number of slots, so all is whole numbers.
    """
    size, total = len(counts), sum(counts)
    left = [n * size for n in counts]
    cuts, aliases = [total] * size, list(range(size))
    small = [i for i in range(size - 1, -1, -1) if left[i] < total]
    large = [i for i in range(size - 1, -1, -1) if left[i] > total]
    while small and large:
        i, j = small.pop(), large[-1]
        cuts[i], aliases[i] = left[i], j
        left[j] -= total - left[i]
        if left[j] <= total:
            large.pop()
            if left[j] < total:
                small.append(j)
    return cuts, aliases


def with_aliases(rows: DataFrame) -> DataFrame:
    """Adds ``cuts, aliases`` to rows with ``counts``."""
    schema = rows.withColumn("cuts", F.lit(None).cast("array<long>")).withColumn("aliases", F.lit(None).cast("array<int>")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [alias_table(c) for c in b.column("counts").to_pylist()]
            columns = [*b.columns, pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "cuts", "aliases"])

    return rows.mapInArrow(add, schema)


def rows_of(model: DataFrame) -> DataFrame:
    """``k, prefix, total, successors, counts, cuts, aliases`` of every prefix with occurrences."""
    entries = F.array_sort(F.collect_list(F.struct("successor", F.col("n").cast("long").alias("n"))))
    per = model.where("n > 0").groupBy("k", "prefix").agg(entries.alias("e"), F.sum("n").cast("long").alias("total"))
    return with_aliases(per.select("k", "prefix", "total", F.col("e.successor").alias("successors"), F.col("e.n").alias("counts")))


def uniform(seed: Column, draw: int) -> Column:
    """A number from 0 to below 1 by seed and draw, with 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(seed, F.lit(draw)), 11) / F.lit(float(1 << 53))


def drawn(seed: Column) -> Column:
    """Successor of a row under one seed: one number picks a slot, another a unit of it."""
    slot = F.floor(uniform(seed, 1) * F.size("counts")).cast("int")
    kept = uniform(seed, 2) * F.col("total") < F.get("cuts", slot)
    return F.get("successors", F.when(kept, slot).otherwise(F.get("aliases", slot)))


@dataclass
class Stored:
    """A model in a catalog table."""

    table: DataFrame
    parts: int

    @classmethod
    def write(cls, model: DataFrame, name: str | None = None, path: str | None = None, parts: int = PARTS, buckets: int = BUCKETS) -> Stored:
        """Store a model as a table, of a new name if none is given, in the warehouse or at ``path``."""
        spark = model.sparkSession
        name = name or "gramlake_model_" + uuid.uuid4().hex
        rows = rows_of(model)
        part = F.when(F.col("k") > 0, cls._part(rows, "prefix", parts)).otherwise(F.lit(-1))
        # a task writes whole buckets, so that a bucket is one file a part and stays sorted
        dealt = rows.withColumn("part", part).repartition(buckets, "prefix").sortWithinPartitions("part", "prefix")
        writer = dealt.write.partitionBy("part").bucketBy(buckets, "prefix").sortBy("prefix")
        writer = writer.option("path", path) if path else writer
        writer.format("parquet").saveAsTable(name)
        return cls(spark.table(name), parts)

    @classmethod
    def open(cls, spark: SparkSession, name: str, parts: int = PARTS) -> Stored:
        return cls(spark.table(name), parts)

    @staticmethod
    def _part(rows: DataFrame, prefix: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(prefixes(rows, prefix).root(prefix)), F.lit(parts)).cast("int")

    @property
    def empty(self) -> DataFrame:
        """The row of the empty prefix."""
        return self.table.where("part = -1 and k = 0")

    def suffixes(self, queries: DataFrame) -> DataFrame:
        """Distinct ``prefix`` once per suffix that is not empty: adds ``k, match, part``."""
        kind = prefixes(queries)
        rows = queries.select("prefix").distinct().where(kind.size("prefix") > 0)
        rows = rows.select("prefix", F.explode(F.sequence(F.lit(1), kind.size("prefix"))).alias("k")).withColumn("match", kind.last("prefix", "k"))
        return rows.withColumn("part", self._part(rows, "prefix", self.parts))

    def read(self, suffixes: DataFrame) -> DataFrame:
        """The rows of the parts that the suffixes end in; at most ``parts`` numbers come to the driver."""
        wanted = sorted(r["part"] for r in suffixes.select("part").distinct().collect())
        return self.table.where(F.col("part").isin(wanted)).drop("part")

    def matches(self, queries: DataFrame) -> DataFrame:
        """Queries whose whole prefix is in the model."""
        rows = self.suffixes(queries).where(F.col("k") == prefixes(queries).size("prefix"))
        known = self.read(rows).select(F.col("prefix").alias("match"))
        return queries.join(rows.join(known, "match").select("prefix"), "prefix", "left_semi")

    def longest_suffix(self, queries: DataFrame) -> DataFrame:
        """Distinct ``prefix`` -> ``match, match_length, total``, as ``score.longest_suffix``."""
        rows = self.suffixes(queries)
        known = self.read(rows).select(F.col("prefix").alias("match"), "total")
        best = rows.join(known, "match").groupBy("prefix").agg(F.max(F.struct("k", "match", "total")).alias("m"))
        kind = prefixes(queries)
        every = queries.select("prefix").distinct().join(best, "prefix", "left").crossJoin(F.broadcast(self.empty.select(F.col("total").alias("everything"))))
        nothing = F.array().cast(kind.type) if isinstance(kind.type, ArrayType) else F.lit("")
        return every.select("prefix", F.coalesce("m.match", nothing).alias("match"), F.coalesce("m.k", F.lit(0)).alias("match_length"), F.coalesce("m.total", "everything").alias("total"))

    def probabilities(self, queries: DataFrame, back_off_at_zero: bool = True) -> DataFrame:
        """Adds ``match_length`` and ``probability`` of ``successor``, as ``score.probabilities``.

        The count of the successor is taken from the row that matches, within
        the join; its array goes no further.
        """
        distinct = queries.select("prefix", "successor").distinct()
        rows = self.suffixes(distinct)
        at = F.array_position("successors", F.col("successor")).cast("int")
        n = F.when(at > 0, F.element_at("counts", at)).otherwise(F.lit(0))
        known = self.read(rows).select(F.col("prefix").alias("match"), "total", "successors", "counts")
        hits = distinct.join(rows, "prefix").join(known, "match").select("prefix", "successor", F.struct("k", "total", n.alias("n")).alias("m"))
        best = hits.groupBy("prefix", "successor").agg(F.max("m").alias("m"))
        everything = self.empty.select(F.col("total").alias("everything"))
        unigram = self.empty.select(F.explode(F.arrays_zip("successors", "counts")).alias("e")).select(F.col("e.successors").alias("successor"), F.col("e.counts").alias("uni"))
        known = queries.join(best, ["prefix", "successor"], "left").join(F.broadcast(unigram), "successor", "left").join(F.broadcast(everything), how="left")
        uni = F.coalesce(F.col("uni") / F.col("everything"), F.lit(0.0))
        own = F.when(F.col("m").isNull(), uni).otherwise(F.col("m.n") / F.col("m.total"))
        if back_off_at_zero:
            own = F.when(own > 0, own).otherwise(uni)
        return known.select(*queries.columns, F.coalesce("m.k", F.lit(0)).alias("match_length"), own.alias("probability"))

    def sample(self, queries: DataFrame) -> DataFrame:
        """``seed, prefix`` -> adds ``match_length, successor`` drawn at the longest known suffix.

        The join has as many rows as there are draws.
        """
        found = self.longest_suffix(queries).select("prefix", "match", "match_length")
        asked = queries.join(found, "prefix").withColumn("seed", F.col("seed").cast("long"))
        columns = ["total", "successors", "counts", "cuts", "aliases"]
        deep = asked.where("match_length > 0").withColumn("part", self._part(asked, "match", self.parts))
        known = self.read(deep).select(F.col("prefix").alias("match"), *columns)
        some = deep.join(known, "match").select(*queries.columns, "match_length", drawn(F.col("seed")).alias("successor"))
        # draws from the empty prefix have no key to be dealt by
        rest = asked.where("match_length = 0").crossJoin(F.broadcast(self.empty.select(*columns)))
        return some.unionByName(rest.select(*queries.columns, "match_length", drawn(F.col("seed")).alias("successor")))
