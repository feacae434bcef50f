"""Models and vocabularies that streams keep up to date, whatever happens to the stream.

A kept table is a folder of segments and a manifest that names those which
count.  Every micro-batch writes one segment of its own and then a manifest of
the next number; a batch that comes again after a failure finds its number in
the manifest, or overwrites what its lost attempt left.  When a level has
``fan`` segments they are added up into one of the next level, so a count is
written again a logarithm of times, and never more than ``fan`` segments a
level are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gramlake.functions import language
from gramlake.operators import model, ngrams

#: Segments of a level that are added up.
FAN = 8


@dataclass(frozen=True)
class Segment:
    """Rows of the batches ``first`` to ``last``."""

    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"level-{self.level}/batches-{self.first}-{self.last}"


class Kept:
    """A table of segments below ``path``, in any store that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[Segment]:
        """The segments of the newest manifest."""
        number = self._newest()
        if not number:
            return []
        # rows of the segments, a few tens
        return [Segment(r["level"], r["first"], r["last"]) for r in self.spark.read.schema("level int, first long, last long").json(f"{self.path}/manifest-{number}.json").collect()]

    def _newest(self) -> int:
        if not self._fs.exists(self._path(self.path)):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _commit(self, segments: list[Segment]) -> None:
        """A manifest is complete before it has its name; the one before is kept, older ones go."""
        number = self._newest() + 1
        place, ready = self._path(f"{self.path}/_manifest-{number}"), self._path(f"{self.path}/manifest-{number}.json")
        stream = self._fs.create(place, True)
        stream.write("".join(json.dumps(asdict(s)) + "\n" for s in segments).encode())
        stream.close()
        self._fs.rename(place, ready)
        self._fs.delete(self._path(f"{self.path}/manifest-{number - 2}.json"), False)

    def _rows(self, segment: Segment) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{segment.name}")

    def read(self, segments: list[Segment] | None = None) -> DataFrame:
        """The rows of all segments."""
        every = self.segments() if segments is None else segments
        if not every:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, map(self._rows, every))

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Make ``rows`` the segment of a batch; nothing happens if the table has that batch."""
        have = self.segments()
        if any(s.first <= batch <= s.last for s in have):
            return False
        new = Segment(0, batch, batch)
        rows.write.mode("overwrite").parquet(f"{self.path}/{new.name}")
        self._commit([*have, new])
        return True

    def compact(self, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
        """Add up full levels, lowest first; what was added up goes once the manifest lacks it."""
        level = 0
        while True:
            have = self.segments()
            own = sorted((s for s in have if s.level == level), key=lambda s: s.first)
            if not any(s.level >= level for s in have):
                return
            if len(own) >= fan:
                new = Segment(level + 1, own[0].first, own[-1].last)
                merge(self.read(own)).write.mode("overwrite").parquet(f"{self.path}/{new.name}")
                self._commit([s for s in have if s.level != level] + [new])
                for s in own:
                    self._fs.delete(self._path(f"{self.path}/{s.name}"), True)
            level += 1


MODEL = "k int, prefix string, successor string, n long"


def kept_model(spark: SparkSession, path: str) -> DataFrame:
    """The sparse counts of all batches so far; ``ngrams.densify`` makes them dense."""
    return model.merge(Kept(spark, path, MODEL).read())


def keep_model(stream: DataFrame, block: int, path: str, checkpoint: str, fan: int = FAN, text: str = "text", **events) -> DataStreamWriter:
    """Counts of a stream of texts into the kept table at ``path``; start the writer to run it.

    A batch that is interrupted at any place and comes again counts once.
    """

    def take(batch: DataFrame, number: int) -> None:
        table = Kept(batch.sparkSession, path, MODEL)
        table.add(ngrams.sparse_counts(batch, block, text, dealt=True, **events), number)
        table.compact(model.merge, fan)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


VOCABULARY = "piece string, token int"


def kept_language(spark: SparkSession, path: str) -> DataFrame:
    return Kept(spark, path, VOCABULARY).read()


def extend_language(docs: DataFrame, path: str, batch: int, order: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """Number the characters of an arrival that are new, after all that are known; known ones keep their numbers.

    Arrivals that follow each other in ``order`` give the numbers of one pass
    over all of them, however they are split.  Returns the vocabulary.
    """
    spark = docs.sparkSession
    table = Kept(spark, path, VOCABULARY)
    known = table.read()
    new = language.char_language_first_seen(docs, order, text).join(known.select("piece"), "piece", "left_anti")
    (last,) = known.agg(F.coalesce(F.max("token"), F.lit(0))).first()
    table.add(language.renumbered(new, last), batch)
    table.compact(lambda rows: rows, fan)
    return table.read()


def keep_language(stream: DataFrame, path: str, checkpoint: str, order: str = "doc_id", text: str = "text") -> DataStreamWriter:
    """The characters of a stream of texts, numbered as they are first seen."""

    def take(batch: DataFrame, number: int) -> None:
        extend_language(batch, path, number, order, text)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
