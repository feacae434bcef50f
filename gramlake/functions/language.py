"""Languages: pieces of text and their tokens, as a ``vocab(piece, token)`` relation.

Encoding is greedy from the right: at each end the longest piece that ends
there is taken.  An automaton does so for whole Arrow batches, one way for
vocabularies of any size (``functions.automaton``).
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramlake.functions import wire
from gramlake.functions.automaton import Automaton, distinct_characters, first_places
from gramlake.operators.ngrams import chars, spread


class Language:
    """A small vocabulary known to the driver: ``{piece: token}``."""

    def __init__(self, pieces: dict[str, int], name: str = ""):
        if any(not p for p in pieces):
            raise ValueError("a piece must not be empty")
        if len(set(pieces.values())) != len(pieces):
            raise ValueError("two pieces have the same token")
        self.pieces, self.name = dict(pieces), name

    @classmethod
    def from_json(cls, text: str, name: str = "") -> Language:
        return cls({str(k): int(v) for k, v in json.loads(text).items()}, name)

    @classmethod
    def from_json_file(cls, spark: SparkSession, path: str) -> Language:
        (row,) = spark.read.text(path, wholetext=True).collect()
        return cls.from_json(row[0], path)

    @classmethod
    def from_bytes(cls, data: bytes) -> Language:
        """From a protocol buffer message."""
        message = wire.unpack("Language", data)
        return cls(wire.language_pieces(message), message["name"])

    def to_bytes(self) -> bytes:
        return wire.pack("Language", wire.language_message(self.pieces, self.name))

    @classmethod
    def from_corpus(cls, docs: DataFrame, text: str = "text", limit: int = 100_000) -> Language:
        """Distinct characters in code point order, from 0; their number is checked."""
        rows = char_language(docs, text).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} distinct characters")
        return cls({r["piece"]: r["token"] for r in rows})

    @classmethod
    def from_ranks(cls, path: str) -> Language:
        """The pieces of a public rank file (base64 and number a line) that are whole characters."""
        pieces = {}
        with open(path, encoding="ascii") as lines:
            for line in lines:
                raw, token = line.split()
                try:
                    pieces[base64.b64decode(raw).decode("utf-8")] = int(token)
                except UnicodeDecodeError:
                    continue
        return cls(pieces, path)

    def define(self, piece: str | bytes, token: int) -> Language:
        piece = piece.decode() if isinstance(piece, bytes) else piece
        return Language(self.pieces | {piece: token}, self.name)

    def define_all(self, pieces: dict[str, int]) -> Language:
        """Many pieces at once; none may have a token that another has."""
        return Language(self.pieces | pieces, self.name)

    def to_json(self) -> str:
        return json.dumps(self.pieces, ensure_ascii=False)

    def vocab(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.pieces.items()), "piece string, token int")

    @property
    def size(self) -> int:
        return len(self.pieces)

    @property
    def max_token(self) -> int:
        return max(self.pieces.values(), default=-1)

    @property
    def depth(self) -> int:
        return max(map(len, self.pieces), default=0)

    def memory(self) -> int:
        return sum(len(p.encode()) + 4 for p in self.pieces)

    def pattern(self) -> str:
        """Reversed pieces, longest first, each as a literal."""
        order = sorted(self.pieces, key=lambda p: (-len(p), p))
        return "|".join(re.sub(r"([^\w\s])|([\n\r\t\f\v])", lambda m: "\\" + m[1] if m[1] and ord(m[1]) < 128 else m[0], p[::-1]) for p in order)

    def split(self, text: Column, strict: bool = False) -> Column:
        """The pieces of a text in order; unknown characters are skipped, or raise if strict."""
        pieces = F.reverse(F.transform(F.regexp_extract_all(F.reverse(text), F.lit("(?s)" + self.pattern()), F.lit(0)), F.reverse))
        if not strict:
            return pieces
        covered = F.aggregate(pieces, F.lit(0), lambda a, p: a + F.length(p)) == F.length(text)
        return F.when(covered, pieces).otherwise(F.raise_error(F.concat(F.lit("not encodable: "), F.substring(text, 1, 40))).cast("array<string>"))

    def encode(self, text: Column, strict: bool = False) -> Column:
        """Array of tokens; unknown characters are skipped, or raise if ``strict``; a null text has null tokens."""
        automaton = Automaton(self.pieces)

        @F.arrow_udf("array<int>")
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # a batch goes back in slices: its tokens are never held together
            for texts in batches:
                yield from automaton.encoded(texts, strict)

        return encoded(text)

    def encode_text(self, text: str, strict: bool = False) -> list[int]:
        """The tokens of one text in Python."""
        return greedy(self.pieces, self.depth, text, strict)

    def decode_tokens(self, tokens: list[int]) -> str:
        """The text of one list of tokens in Python; unknown tokens raise."""
        back = {t: p for p, t in self.pieces.items()}
        if unknown := [t for t in tokens if t not in back]:
            raise ValueError(f"unknown tokens {unknown[:5]}")
        return "".join(back[t] for t in tokens)

    def decode(self, tokens: Column, strict: bool = True) -> Column:
        """Text of an array of tokens; unknown tokens raise, or are skipped."""
        back = {t: p for p, t in self.pieces.items()}
        table = F.array(*[F.lit(back.get(t)).cast("string") for t in range(self.max_token + 1)]) if self.pieces else F.array().cast("array<string>")
        pieces = F.transform(tokens, lambda t: F.when(t >= 0, F.get(table, t)))
        if not strict:
            return F.array_join(pieces, "")
        known = F.forall(pieces, lambda p: p.isNotNull())
        return F.when(known, F.array_join(pieces, "")).otherwise(F.raise_error(F.lit("unknown token")).cast("string"))

    def is_valid(self, text: Column) -> Column:
        """Whether a text encodes without skipping anything."""
        return F.regexp_replace(F.reverse(text), F.lit("(?s)" + self.pattern()), F.lit("")) == "" if self.pieces else text == ""


def greedy(table: dict[str, int], longest: int, text: str, strict: bool) -> list[int]:
    """Tokens of a text, from its end: the longest piece that ends there, or nothing for an unknown character."""
    out, end = [], len(text)
    while end:
        for n in range(min(longest, end), 0, -1):
            token = table.get(text[end - n : end])
            if token is not None:
                out.append(token)
                end -= n
                break
        else:
            if strict:
                raise ValueError(f"not encodable at {end - 1}: {text[end - 1]!r}")
            end -= 1
    return out[::-1]


def char_language(docs: DataFrame, text: str = "text") -> DataFrame:
    """``piece, token``: distinct characters in code point order, numbered from 0."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.uint32)
        for b in batches:
            held = np.union1d(held, distinct_characters(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in held.tolist()], pa.string())], ["piece"])

    pieces = spread(docs.select(F.col(text).cast("string"))).mapInArrow(distinct, "piece string").distinct()
    return pieces.select("piece", (F.row_number().over(Window.orderBy("piece")) - 1).alias("token"))


def char_language_first_seen(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """``piece, token``: characters in the order in which a corpus shows them, from 1.

    Each batch of documents adds one row per character that it holds, its first
    document and place, so no text is copied, sorted or shuffled.
    """

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, row, at = first_places(b.column(1), _ranks(b.column(0)))
            if len(codes):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(at), pa.array([chr(c) for c in codes.tolist()], pa.string())], ["order", "at", "piece"])

    kind = docs.schema[order].dataType.simpleString()
    each = spread(docs.select(order, F.col(text).cast("string"))).mapInArrow(firsts, f"order {kind}, at int, piece string")
    first = each.groupBy("piece").agg(F.min(F.struct("order", "at")).alias("first"))
    return first.select("piece", F.row_number().over(Window.orderBy("first", "piece")).alias("token"))


def _ranks(column: pa.Array) -> np.ndarray:
    """Places of values among their distinct ones, as Spark sorts them: nulls first, NaN last."""
    if not pa.types.is_floating(column.type):
        return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    nan = pc.fill_null(pc.is_nan(column), False)
    ranks = pc.rank(pc.if_else(nan, pa.scalar(None, column.type), column), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    return np.where(nan.to_numpy(zero_copy_only=False), len(column) + 1, ranks)


def renumbered(vocab: DataFrame, after: int) -> DataFrame:
    """The pieces in the order of their tokens, numbered on from ``after``; a row per piece of a vocabulary."""
    return vocab.select("piece", (F.row_number().over(Window.orderBy("token")) + after).cast("int").alias("token"))


def language_json(vocab: DataFrame) -> DataFrame:
    """One row: the vocabulary as a JSON object."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("piece", "token"))))
    return vocab.agg(F.to_json(pairs).alias("json"))


def vocab_from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    return texts.select(F.explode(F.from_json(column, "map<string,int>")).alias("piece", "token"))


def length_histogram(pieces: DataFrame, column: str = "piece") -> DataFrame:
    return pieces.groupBy(F.length(column).alias("length")).agg(F.count("*").alias("n"))
