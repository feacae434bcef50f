"""Shared helpers: scratch tables, Arrow mapping in small slices, table access."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker turns into objects at once.
SLICE_BYTES = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is set up, but only for a local
    master: on a cluster no executor could see another machine's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="gramlake-")
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths made in the present scope, if there is one.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def adopt(path: str) -> None:
    """Have the present scope remove a path that was made before it."""
    made = _made.get()
    if made is not None:
        made.append(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[set[str]]:
    """Tables written within the scope are removed at its end, but for the paths put into the set it yields."""
    made: list[str] = []
    keep: set[str] = set()
    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        for path in set(made) - keep:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to replicated storage, a lost executor loses nothing."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Besides cutting the lineage this gives the planner the table's true size,
    so Spark itself decides by that size whether it is broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """One object per Python worker, made once and used by all tasks that the worker runs.

    A worker keeps the object of one key at a time.  Functions reach workers
    anew with every task, so the object is held by a module of its own.
    """
    held = sys.modules.setdefault("_gramlake_kept", types.ModuleType("_gramlake_kept")).__dict__
    if held.get("key") != key:
        held["made"] = None
        held["made"], held["key"] = make(), key
        gc.collect()
        gc.freeze()  # large tables without cycles need not be looked through again and again
    return held["made"]


class Recent:
    """A cache of two generations: entries not used while one fills up are forgotten."""

    def __init__(self, size: int):
        self.size, self.now, self._before = size, {}, {}

    def turn(self) -> None:
        """Before a batch: begin a generation if the present one is full."""
        if len(self.now) > self.size:
            self.now, self._before = {}, self.now

    def missing(self, keys: set) -> set:
        """Those of the keys that have to be entered into ``now``; all others are in it."""
        return self.recall(keys.difference(self.now))

    def recall(self, absent: set) -> set:
        """As ``missing``, for keys that are not in ``now``."""
        before = self._before
        again = [k for k in absent if k in before] if before else []
        self.now.update(zip(again, map(before.__getitem__, again)))
        return absent.difference(again) if again else absent


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch whose ``column`` holds about SLICE_BYTES at most."""
    rows, size = batch.num_rows, max(1, batch.column(column).nbytes)
    step = max(1, min(rows, int(rows * SLICE_BYTES / size)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def map_slices(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices; ``make`` builds the per-worker function once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column):
                yield work(part)

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables; the input is sorted by the keys.

    One group is held at a time; a group may span any number of batches.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
