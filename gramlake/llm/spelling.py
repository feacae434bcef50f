"""Spelling variants by full neighbourhood generation.

Every word emits all distinct words at one deleted, replaced or inserted code
point over the alphabet that the vocabulary shows; these are joined to the
vocabulary by equality, so a partner needs no check of its distance.

A word of L letters has about (2 L + 1) A neighbours over A letters, hardly
any of them words.  As Spark's own hash joins do, a Bloom filter of the
vocabulary drops most of those that are no word before the shuffle.  The
filter has a fixed largest size; where the vocabulary outgrows it, more rows
are shuffled and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import written

#: Letters of a word: a class of a regular expression.
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, EVERY = 5, 3, 97
#: A form has at least so many times the occurrences of its word.
FORM_RATIO = 2
#: Bits of the filter per word, and at most (32 MB).
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
PROBES = 3
#: Candidates that a task has in memory at once, about.
BLOCK = 1 << 20
#: Words of a task.
TASK_WORDS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Odd base of the hash, its inverse modulo 2 ** 64, and the multipliers of the probes.
BASE = 0x9E37_79B9_7F4A_7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.array([0xD6E8_FEB8_6659_FD93, 0xA076_1D64_78BD_642F, 0xE703_7ED1_A0B4_28DB], dtype=np.uint64)


def spelled(word: Column, doc_id: Column, every: int = EVERY) -> Column:
    """The word, less one letter where ``every`` divides the CRC-32 of ``doc_id:word``."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word), "UTF-8"))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, letters: str = LETTERS, shortest: int = SHORTEST, least: int = LEAST, every: int | None = EVERY) -> DataFrame:
    """``word, n``: runs of letters of at least ``shortest`` code points with at least ``least`` occurrences.

    Only A-Z are lower-cased.  With ``every``, some occurrences lose a letter
    (``spelled``).  A null text has no words; a null doc_id counts as empty.
    """
    # runs that are too short before a letter goes are too short after it
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{letters}]{{{shortest},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("word")).withColumn("word", F.translate("word", UPPER, LOWER))
    if every:
        words = words.select(spelled(F.col("word"), F.col("doc_id"), every).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_hash(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58_476D_1CE4_E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, a row each: sum of letter_hash(c_i) * BASE ** i modulo 2 ** 64."""
    return (letter_hash(codes) * powers(codes.shape[1])).sum(1, dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the words of each length, and their code points, a row each."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        step = max(1, 4 * BLOCK // size)
        for s in range(0, len(own), step):
            part = own[s : s + step]
            joined = "".join([words[i] for i in part])
            yield part, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), size)


def spots(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Bit of each hash under one probe; ``bits`` is a power of two."""
    x = hashes * MIX[probe]
    x ^= x >> np.uint64(32)
    return (x * MIX[probe]) >> np.uint64(64 - (bits.bit_length() - 1))


def in_filter(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be words."""
    bits, left = 8 * len(bitmap), np.arange(hashes.size)
    for probe in range(PROBES):
        at = spots(hashes[left], probe, bits)
        left = left[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0]
    return left


def neighbours(codes: np.ndarray, alphabet: np.ndarray, bitmap: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All distinct words at one edit of each row's word that pass the filter: rows, and the words' code points.

    Hashes of edited words come from those of the word's front and back.  Of
    equal letters in a row the first is deleted, and none is inserted behind
    its equal, so no word comes twice.
    """
    n, size = codes.shape
    weight = powers(size + 1)
    terms = letter_hash(codes) * weight[:-1]
    front = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], 1)
    whole = front[:, -1:]
    back = whole - front  # terms from a place on
    own = letter_hash(alphabet)
    base, inverse = np.uint64(BASE), np.uint64(INVERSE)
    before = np.concatenate([np.full((n, 1), -1, dtype=np.int64), codes.astype(np.int64)], 1)  # the letter before a place

    def passed(hashes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        flat = np.flatnonzero(allowed)
        return flat if bitmap is None else flat[in_filter(bitmap, hashes.ravel()[flat])]

    hit = passed(front[:, :-1] + back[:, 1:] * inverse, codes != before[:, :-1])
    for s in range(0, len(hit), step := max(1, 4 * BLOCK // size)):
        row, at = np.divmod(hit[s : s + step], size)
        keep = np.arange(size)[None] != at[:, None]
        yield row, codes[row][keep].reshape(len(row), size - 1)
    letters = len(alphabet)
    if not letters:
        return
    span = max(1, BLOCK // (n * letters))
    for s in range(0, size + 1, span):
        e = min(size + 1, s + span)
        gain = own[None, None] * weight[None, s:e, None]
        within = min(e, size)
        if s < within:
            kept = whole[:, :, None] - terms[:, s:within, None]
            hit = passed(kept + gain[:, : within - s], codes[:, s:within, None] != alphabet[None, None])
            yield from edited(codes, alphabet, hit, s, within - s, False)
        hit = passed((front[:, s:e] + back[:, s:e] * base)[:, :, None] + gain, before[:, s:e, None] != alphabet[None, None])
        yield from edited(codes, alphabet, hit, s, e - s, True)


def edited(codes: np.ndarray, alphabet: np.ndarray, hit: np.ndarray, first: int, span: int, insert: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with a letter replaced, or inserted, at flat positions of (row, place from ``first``, letter)."""
    size = codes.shape[1]
    for s in range(0, len(hit), step := max(1, 4 * BLOCK // size)):
        rest, letter = np.divmod(hit[s : s + step], len(alphabet))
        row, at = np.divmod(rest, span)
        at += first
        if insert:
            out = np.empty((len(row), size + 1), dtype="<u4")
            spread = np.arange(size)[None] + (np.arange(size)[None] >= at[:, None])
            np.put_along_axis(out, spread, codes[row], 1)
        else:
            out = codes[row]
        out[np.arange(len(row)), at] = alphabet[letter]
        yield row, out


def as_words(codes: np.ndarray) -> list[str]:
    size = codes.shape[1]
    text = np.ascontiguousarray(codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + size] for i in range(0, len(text), size)] if size else [""] * len(codes)


def bitmap_of(vocab: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of the words: parts make 64-bit lanes, Spark joins them; at most MOST_FILTER_BITS come to the driver."""
    bits = 1 << min(MOST_FILTER_BITS.bit_length() - 1, max(10, (FILTER_BITS * n - 1).bit_length()))

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes in by_length(b.column("word").to_pylist()):
                h = word_hash(codes)
                at = np.unique(np.concatenate([spots(h, probe, bits) for probe in range(PROBES)]))
                lane, start = np.unique(at >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(lane.astype(np.int64)), pa.array(value.view(np.int64))], ["lane", "value"])

    rows = vocab.select("word").mapInArrow(lanes, "lane long, value long").groupBy("lane").agg(F.expr("bit_or(value)").alias("value")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows.column("lane").to_numpy()] = rows.column("value").to_numpy()
    return out.view(np.uint8)


def near_words(vocab: DataFrame) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words of ``vocab`` (``word, n``, words distinct) at one edit."""
    spark = vocab.sparkSession
    n = vocab.count()
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), dtype=np.uint32)
    shared = spark.sparkContext.broadcast((alphabet, bitmap_of(vocab, n)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, bitmap = shared.value
        for b in batches:
            words = b.column("word").to_pylist()
            for own, codes in by_length(words):
                step = max(1, BLOCK // (codes.shape[1] * max(1, len(alphabet))))
                for s in range(0, len(own), step):
                    part = own[s : s + step]
                    for row, made in neighbours(codes[s : s + step], alphabet, bitmap):
                        if len(row):
                            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in part[row]], pa.string()), pa.array(as_words(made), pa.string())], ["word", "near"])

    parts = max(n // TASK_WORDS + 1, spark.sparkContext.defaultParallelism)
    pairs = vocab.select("word").repartition(parts).mapInArrow(emit, "word string, near string")
    return pairs.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` -> ``word, root``: the last word that forms lead to.

    Each round doubles the length of the paths that are known; as a form has
    at least twice its word's occurrences, paths are short and have no rings.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = written(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = ahead.select("word", "root")
        if not ahead.where("moved").take(1):
            return now


def variants(docs: DataFrame, ratio: int = FORM_RATIO, **words) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id, text``); see ``vocabulary``.

    A word's form is the commonest of its near words (ties: the smallest by
    code points), if it has ``ratio`` times the word's occurrences; its root is
    where forms end.  Texts without words, null texts and an empty table give
    no rows; equal texts, and rows that repeat a doc_id, count each time; other
    columns are ignored.  Words may be of any length.
    """
    vocab = written(vocabulary(docs, **words), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    per = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best)
    formed = F.col("best").isNotNull() & (-F.col("best.m") >= ratio * F.col("n"))
    rows = vocab.join(per, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")
    )
    rows = written(rows, "spelling-forms")
    known = rows.join(roots(rows.where("form is not null")), "word", "left")
    return known.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_query(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole ``documents`` texts, with the contract's deletions."""
    return variants(docs.select("doc_id", "text"))
