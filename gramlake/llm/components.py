"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (partially aggregated before its shuffle) and
a join back to the edges, so a hub with a third of all edges is pre-aggregated;
the minima are a table of their own, so both sides of the join are plain
shuffles, which adaptive execution can split at the hub.  No list of neighbours
is ever built and nothing but one checksum row reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import checkpointed, written


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    if both_ways:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = written(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-low")
    joined = sides.join(low, "u")
    if both_ways:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of longs -> ``(node, root)``, root the smallest node reachable.

    Nodes without edges to another node are absent.  Null ends, self-loops and
    repeated edges are ignored; no edges give an empty result.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    edges = checkpointed(edges)
    before = _state(edges)
    while before[0]:
        edges = checkpointed(_star(_star(edges, True), False))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Forest:
    """Components among ``n`` local items; holds one edge per joined item at most."""

    def __init__(self, n: int):
        self.low = np.arange(n)
        self._i: list[np.ndarray] = []
        self._j: list[np.ndarray] = []
        self._held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self._i.append(i)
        self._j.append(j)
        self._held += len(i)
        if self._held > 1_000_000:
            self.labels()

    def labels(self) -> np.ndarray:
        """Smallest item of each item's component."""
        if self._held:
            i, j, low = np.concatenate(self._i), np.concatenate(self._j), self.low
            while True:
                a, b = low[i], low[j]
                open_ = a != b
                if not open_.any():
                    break
                i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(low, low[low]):
                    low = low[low]
            self.low, self._i, self._j, self._held = low, [], [], 0
        return self.low
