"""Aggregation by a combiner of one's own: create, add, merge and extract.

Sums and counts need none of this; it is for states that are no plain sum.
Each task adds its rows to states by key and lets them go as bytes when there
are many; states of a key are merged by (key, salt) first, so a key with a third
of all rows is merged by several tasks, and then by key.  Only states are
shuffled.  ``merge`` has to be associative and commutative.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose states a task has at once.
HELD_KEYS = 100_000
#: Tasks that merge the states of one key in the first round.
SALTS = 8


class Combiner:
    """What happens to the states; subclasses are sent to the tasks."""

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, row: tuple) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def extract(self, state: Any) -> Iterable[tuple]:
        """The rows that a key's state stands for."""
        raise NotImplementedError


class TopSuccessors(Combiner):
    """The ``count`` commonest successors (ties: the smallest) of rows ``successor, n`` that name each successor once.

    States are pruned as they grow and as they are merged.
    """

    def __init__(self, count: int):
        self.count = count

    def _pruned(self, state: list) -> list:
        return sorted(state)[: self.count]

    def create(self) -> list:
        return []

    def add(self, state: list, row: tuple) -> list:
        state.append((-row[1], row[0]))
        return self._pruned(state) if len(state) >= 4 * self.count else state

    def merge(self, a: list, b: list) -> list:
        return self._pruned(a + b)

    def extract(self, state: list) -> Iterable[tuple]:
        return [(s, -n, place) for place, (n, s) in enumerate(self._pruned(state), 1)]


def combine(df: DataFrame, keys: list[str], values: list[str], combiner: Combiner, result: str, held: int = HELD_KEYS, salts: int = SALTS) -> DataFrame:
    """``keys..., result...`` for every key; ``result`` is the schema of the rows that ``extract`` makes.

    Null keys are a key like any other; an empty table gives no rows.
    """
    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    states = f"{key_schema}, __salt int, __state binary"
    kinds = df.select(*keys).limit(0).toArrow().schema

    def packed(now: dict, salt: int) -> pa.RecordBatch:
        columns = list(zip(*now)) if keys else []
        arrays = [pa.array(c, f.type) for c, f in zip(columns, kinds)]
        arrays += [pa.array([salt] * len(now), pa.int32()), pa.array([pickle.dumps(s) for s in now.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [*keys, "__salt", "__state"])

    def rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(n).to_pylist() for n in names))

    def hashable(key: tuple) -> tuple:
        return tuple(tuple(x) if isinstance(x, list) else x for x in key)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, now, n = TaskContext.get().partitionId() % salts, {}, len(keys)
        for row in rows(batches, keys + values):
            key = hashable(row[:n])
            now[key] = combiner.add(now[key] if key in now else combiner.create(), row[n:])
            if len(now) >= held:
                yield packed(now, salt)
                now = {}
        if now:
            yield packed(now, salt)

    def merged(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Any]]:
        """Keys and merged states of sorted rows; one key is held at a time."""
        key, state = None, None
        for row in rows(batches, [*names, "__state"]):
            other = pickle.loads(row[-1])
            if key == (mine := hashable(row[:-1])) and state is not None:
                state = combiner.merge(state, other)
            else:
                if state is not None:
                    yield key, state
                key, state = mine, other
        if state is not None:
            yield key, state

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = {}
        for key, state in merged(batches, [*keys, "__salt"]):
            # a task may have several salts of a key
            mine = key[:-1]
            now[mine] = combiner.merge(now[mine], state) if mine in now else state
            if len(now) >= held:
                yield packed(now, 0)
                now = {}
        if now:
            yield packed(now, 0)

    fields = [c.split()[0] for c in result.split(", ")]
    final = df.sparkSession.createDataFrame([], f"{key_schema}, {result}").schema
    types = df.sparkSession.createDataFrame([], final).toArrow().schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, state in merged(batches, keys):
            out += [(*key, *row) for row in combiner.extract(state)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], [*keys, *fields])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], [*keys, *fields])

    one = df.select(*keys, *values).mapInArrow(gather, states)
    two = one.repartition(*keys, "__salt").sortWithinPartitions(*keys, "__salt").mapInArrow(part, states)
    return two.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(extract, final)
