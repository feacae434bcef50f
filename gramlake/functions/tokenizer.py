"""Tokenizers from public vocabulary files, for models over large vocabularies.

The file is read by path on the driver and its text travels with the function,
so executors need no file; the ``tokenizers`` library does the encoding, one
Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode(docs: DataFrame, path: str, end: int | None = None, unknown: str = "keep", text: str = "text", column: str = "tokens") -> DataFrame:
    """Adds ``tokens (array<int>)`` of whole texts, ``end`` appended if given.

    Characters that the vocabulary lacks become its unknown token: they stay
    so (``keep``), are left out (``drop``), or raise (``strict``).  Null texts
    have null tokens.
    """
    if unknown not in ("keep", "drop", "strict"):
        raise ValueError("unknown is one of keep, drop and strict")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    docs = docs.drop(column)
    names = [*docs.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        library.no_truncation()
        library.no_padding()
        lost = library.model.unk_token if hasattr(library.model, "unk_token") else None
        lost = None if lost is None else library.token_to_id(lost)
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                texts = part.column(text).to_pylist()
                ids = [e.ids for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
                if lost is not None and unknown != "keep":
                    if unknown == "strict" and any(lost in x for x in ids):
                        raise ValueError("a text holds characters that the vocabulary lacks")
                    ids = [[i for i in x if i != lost] for x in ids]
                ids = [None if t is None else x if end is None else [*x, end] for t, x in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names)

    schema = docs.withColumn(column, F.lit(None).cast("array<int>")).schema
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, column: str = "tokens", text: str = "decoded") -> DataFrame:
    """Adds the text of an array of tokens, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    encoded = encoded.drop(text)
    names = [*encoded.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        for b in batches:
            texts = [None if x is None else library.decode(x, skip_special_tokens=False) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    schema = encoded.withColumn(text, F.lit(None).cast("string")).schema
    return encoded.mapInArrow(run, schema)
