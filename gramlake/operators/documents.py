"""A model per document: its size, and how long it took to count.

A document is a row, so nothing is shuffled and a repeated id is no hot key;
grams are packed into whole numbers and counted by sorting them, a document at
a time.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.functions.automaton import code_points
from gramlake.operators.ngrams import spread

STATISTICS = "in_bytes int, events long, prefixes long, patterns long, occurrences long, depth int, out_bytes long, seconds double"


def grams(codes: np.ndarray, block: int) -> np.ndarray:
    """Events of one text, (events, block + 1): the prefix from its first token on, behind zeros, then the successor."""
    n = len(codes)
    if n <= block:
        return np.zeros((0, block + 1), dtype=np.uint32)
    padded = np.concatenate([np.zeros(block, dtype=np.uint32), codes + np.uint32(1)])
    return np.lib.stride_tricks.sliding_window_view(padded, block + 1)[1 : n - 1]


def measured(codes: np.ndarray, block: int) -> tuple[int, int, int, int, int, int]:
    """``events, prefixes, patterns, occurrences, depth, out_bytes`` of the sparse model of one text."""
    rows = grams(codes, block)
    if not len(rows):
        return 0, 0, 0, 0, 0, 0
    letters, ids = np.unique(rows, return_inverse=True)
    ids, bits = ids.reshape(rows.shape), max(1, (len(letters) - 1).bit_length())
    # as many tokens to a number as fit; two numbers or more are compared one after the other
    per = 63 // bits
    packed = []
    for end in range(block + 1, 0, -per):
        number = np.zeros(len(rows), dtype=np.int64)
        for c in range(max(0, end - per), end):
            number = number << bits | ids[:, c]
        packed.append(number)
    order = np.lexsort(packed) if len(packed) > 1 else np.argsort(packed[0], kind="stable")
    ordered = ids[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
    prefix = np.concatenate([[True], (ordered[1:, :-1] != ordered[:-1, :-1]).any(1)])
    distinct = rows[order][new]
    width = np.where(distinct == 0, 0, 1 + (distinct > 0x80).astype(np.int64) + (distinct > 0x800) + (distinct > 0x10000))
    depth = int((distinct[:, :-1] != 0).sum(1).max())
    return len(rows), int(prefix.sum()), int(new.sum()), len(rows), depth, int(width.sum() + 8 * len(distinct))


def document_models(docs: DataFrame, block: int, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the sizes of each row's sparse model and the seconds that it took.

    Null texts and texts without events have models of nothing; repeated rows
    each have a row.
    """
    keep = [c for c in docs.columns if c != text and c not in {x.split()[0] for x in STATISTICS.split(", ")}]
    names = [*keep, *(x.split()[0] for x in STATISTICS.split(", "))]
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, made = b.column(len(keep)), []
            for i in range(b.num_rows):
                began = time.perf_counter()
                one = column.slice(i, 1)
                codes, _ = code_points(one)
                sizes = measured(codes, block)
                raw = one[0].as_buffer()
                made.append((len(raw) if raw is not None else 0, *sizes, time.perf_counter() - began))
            columns = zip(*made) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    schema = docs.select(*keep).schema
    for field in docs.sparkSession.createDataFrame([], STATISTICS).schema:
        schema = schema.add(field)
    return spread(docs.select(*keep, F.col(text).cast("string").alias(text))).mapInArrow(run, schema)
