"""Table functions for SQL users; pipelines use ``operators.ngrams``.

``ngrams(text, block)`` goes row by row.  ``ngram_counts(table(...), ...)``
takes a table of one column of texts, a batch at a time, and gives the counts
of its events; counts of several batches have to be added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from gramlake.operators.suffixes import Codes, turned_grams


class Ngrams:
    def eval(self, text: str, block: int) -> Iterator[tuple]:
        if text is not None and len(text) > block:
            for i in range(1, len(text) - 1):
                k = min(block, i)
                yield k, text[i - k : i], text[i]


def _counts(block: int) -> type:
    """The table function of one block size: its schema and its state are known before it runs."""
    from pyspark.sql.types import StringType

    codes = Codes(StringType())

    class NgramCounts:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for rows, sizes in turned_grams(*codes.flat(batch.column(0)), block, True, False):
                order = np.lexsort(rows.T[::-1])
                rows, sizes = rows[order], sizes[order]
                start = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
                n = np.diff(np.concatenate([start, [len(rows)]]))
                rows, k = rows[start], sizes[start] - 1
                back = np.arange(block)[None]
                # prefixes are turned round again: the nearest token is the last one
                prefix = np.take_along_axis(rows, np.where(back < k[:, None], k[:, None] - back, 0), 1)
                yield pa.table({"k": pa.array(k.astype(np.int32)), "prefix": codes.column(prefix, k), "successor": codes.single(rows[:, 0]), "n": pa.array(n.astype(np.int64))})

    return NgramCounts


def register(spark: SparkSession, name: str = "ngrams") -> None:
    spark.udtf.register(name, udtf(Ngrams, returnType="k: int, prefix: string, successor: string"))


def register_counts(spark: SparkSession, block: int, name: str = "ngram_counts") -> None:
    """``select * from ngram_counts(table(select text from ...))``: ``k, prefix, successor, n``."""
    spark.udtf.register(name, arrow_udtf(_counts(block), returnType="k int, prefix string, successor string, n bigint"))
