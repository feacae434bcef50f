"""Token ids in sorted-string-table files.

A file holds the documents of one range of doc_id in ascending order:

    data blocks   entries: shared key bytes (1), own key bytes (1), own key,
                  value length (4), value; keys are a byte 0 (no doc_id) or 1,
                  then the doc_id as 8 big-endian bytes with the sign bit
                  turned over, so byte order is id order; every block starts
                  with a whole key and is zstd-packed
    index         per block: last key (9), offset (8), packed size (4), size (4)
    filter        Bloom filter over the keys
    footer        index offset, index count, filter offset, filter bytes,
                  hash count, entries, ids, width of an id, magic

A value is the document's ids as little-endian integers of the footer's width.
Lookup asks the filter, searches the block index and reads one block.

Texts are range-partitioned by doc_id, sorted, and encoded as a file is
written, one file per task; files are read back one per task.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from gramlake.llm.bpe import ENDINGS, byte_alphabet
from gramlake.llm.common import Recent, kept, scratch_path, slices, written

MAGIC = b"GLSST003"
FOOTER = "<QIQIIQQI8s"
INDEX = ">9sQII"
BLOCK_BYTES = 64_000
BITS_PER_KEY, HASHES = 10, 7
KEY_BYTES = 9
#: Text bytes of a file, about.
FILE_BYTES = 32_000_000
def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else struct.pack(">BQ", 1, doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


class Bloom:
    """Double hashing over XXH64 with two seeds."""

    def __init__(self, bits: bytearray, hashes: int = HASHES):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def sized(cls, n: int) -> Bloom:
        return cls(bytearray(max(8, (n * BITS_PER_KEY + 7) // 8)))

    def _spots(self, keys: list[bytes]) -> np.ndarray:
        """(hashes, keys) bit numbers."""
        first, step = (np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], dtype=np.uint64) for seed in (1, 2))
        return (first + np.arange(self.hashes, dtype=np.uint64)[:, None] * (step | np.uint64(1))) % np.uint64(len(self.bits) * 8)

    def add(self, keys: list[bytes]) -> None:
        for s in range(0, len(keys), 100_000):
            spots = self._spots(keys[s : s + 100_000]).ravel()
            np.bitwise_or.at(np.frombuffer(self.bits, dtype=np.uint8), spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[s >> 3] >> (s & 7) & 1 for s in self._spots([key])[:, 0].tolist())


class TableWriter:
    """Appends ``(key, value)`` in ascending key order to a binary stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.codec = out, width, pa.Codec("zstd", compression_level=1)
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys = bytearray()
        self.entries = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        same = 0
        if self.block:
            while same < len(key) and key[same] == self.last[same]:
                same += 1
        self.block += bytes((same, len(key) - same)) + key[same:] + struct.pack("<I", len(value)) + value
        self.last = key
        self.keys += key
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.codec.compress(bytes(self.block), asbytes=True)
            self.out.write(packed)
            self.index.append((self.last, self.at, len(packed), len(self.block)))
            self.at += len(packed)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack(INDEX, *x) for x in self.index)
        bloom = Bloom.sized(self.entries)
        bloom.add([bytes(self.keys[i : i + KEY_BYTES]) for i in range(0, len(self.keys), KEY_BYTES)])
        self.out.write(index + bytes(bloom.bits))
        self.out.write(struct.pack(FOOTER, self.at, len(self.index), self.at + len(index), len(bloom.bits), bloom.hashes, self.entries, self.ids, self.width, MAGIC))


class TableReader:
    """Reads a file by its footer; ``stream`` is seekable."""

    def __init__(self, stream, size: int):
        self.stream, self.codec = stream, pa.Codec("zstd")
        index_at, blocks, bloom_at, bloom_bytes, hashes, self.entries, self.ids, self.width, magic = struct.unpack(FOOTER, self._read(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        raw = self._read(index_at, struct.calcsize(INDEX) * blocks)
        self.index = [struct.unpack_from(INDEX, raw, i * struct.calcsize(INDEX)) for i in range(blocks)]
        self.lasts = [x[0] for x in self.index]
        self.bloom = Bloom(bytearray(self._read(bloom_at, bloom_bytes)), hashes)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, packed, size = self.index[n]
        raw, i, key = self.codec.decompress(self._read(at, packed), decompressed_size=size, asbytes=True), 0, b""
        while i < len(raw):
            same, own = raw[i], raw[i + 1]
            key = key[:same] + raw[i + 2 : i + 2 + own]
            i += 2 + own
            (n_value,) = struct.unpack_from("<I", raw, i)
            yield key, raw[i + 4 : i + 4 + n_value]
            i += 4 + n_value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.index)):
            yield from self.block(n)

    def find(self, doc_id: int | None) -> list[bytes]:
        """Values of a doc_id (several if it was written repeatedly)."""
        key, out = key_of(doc_id), []
        if key not in self.bloom:
            return out
        n = bisect.bisect_left(self.lasts, key)
        while n < len(self.index):
            for k, v in self.block(n):
                if k == key:
                    out.append(v)
                elif k > key:
                    return out
            n += 1
        return out


class WordEncoder:
    """Ids by the tokenizers library, asked once for every distinct word.

    Vocabulary files of this kind normalize (NFC, white space, lower case),
    keep the matches of a pattern that never joins words across white space,
    and merge each match by itself.  So texts are normalized and cut here, and
    the library merges what it has not met yet.  Texts with special tokens or
    unusual white space, and files of any other kind, go to the library whole.
    """

    #: Distinct words, and pieces of words, whose ids a worker keeps in each of two generations.
    CACHE = 400_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = id_width(self.tokenizer)
        self.kind = f"<u{self.width}"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Characters on which Python and the library may disagree about being white space.
        self.odd = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
        self.pattern = self._pattern(json.loads(self.tokenizer.to_str()))
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: No id; parts the words that are cut at once.
        self.parting = (1 << 8 * self.width) - 1
        self.parted = regex.compile(self.pattern.pattern + r"|\n") if self.pattern else None
        self._pieces, self._known = Recent(self.CACHE), Recent(self.CACHE)
        #: Characters that Python knows, of those met so far.
        self._plain: set[str] = set()
        self.signs = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})
        self.ends = np.zeros(1 << 8 * self.width if self.width == 2 else self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def _pattern(spec: dict) -> regex.Pattern | None:
        """The splitting pattern, if the file is of the kind described above."""
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
        known = steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        if not known or spec["model"].get("end_of_word_suffix") != "</w>" or not cuts[0]["invert"] or cuts[0]["behavior"] != "Removed" or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
            return None
        return regex.compile(cuts[0]["pattern"]["Regex"])

    def _ids(self, texts: list[str], by: Tokenizer) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the pattern keeps whole."""
        signs = [p if p.isascii() and p.isalpha() else p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs) for p in pieces]
        out: list[bytes] = []
        for s in range(0, len(pieces), 5000):
            part = signs[s : s + 5000]
            (ids,) = self._ids([" ".join(part)], self.merger)
            # the last token of a piece, and no other, carries the end of a word
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(part):
                raw, w = ids.tobytes(), self.width
                out += [raw[a * w : b * w] for a, b in zip([0, *stops], stops)]
            else:
                out += [x.tobytes() for x in self._ids(part, self.merger)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that may be several pieces: cut all at once; pieces that were met before are not merged again."""
        if not words:
            return []
        flat = self.parted.findall("\n".join(words))
        fresh = list(self._pieces.missing(set(flat) - {"\n"}))
        pieces = self._pieces.now
        pieces["\n"] = np.array([self.parting], dtype=self.kind).tobytes()
        pieces.update(zip(fresh, self._merged(fresh)))
        raw = b"".join(map(pieces.__getitem__, flat))
        stops = (np.flatnonzero(np.frombuffer(raw, dtype=self.kind) == self.parting) * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *(x + self.width for x in stops)], [*stops, len(raw)])]

    @staticmethod
    def _fold(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # by character: Python lowers a final sigma by its context
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _unsure(self, words: set[str]) -> set[str]:
        """Words with characters newer than this Python's Unicode: the library knows better which are letters."""
        met = set("".join([w for w in words if not w.isascii()])) - self._plain
        new = {c for c in met if unicodedata.category(c) == "Cn"}
        if len(self._plain) < 100_000:
            self._plain |= met - new
        return {w for w in words if not new.isdisjoint(w)} if new else set()

    def encode_batch(self, texts: list[str], end: int) -> list[bytes]:
        self._known.turn()
        self._pieces.turn()
        last = np.array([end], dtype=self.kind).tobytes()
        odd = lambda t: self.pattern is None or any(s in t for s in self.special) or self.odd.search(t)
        words = [None if odd(t) else self._fold(t).split() for t in texts]
        flat = list(itertools.chain.from_iterable(ws for ws in words if ws))
        known = self._known.now
        found = list(map(known.get, flat))
        absent = [n for n, ids in enumerate(found) if ids is None]
        self._learn(self._known.recall({flat[n] for n in absent}))
        for n in absent:
            found[n] = known[flat[n]]
        whole = iter(self._ids([t for t, ws in zip(texts, words) if ws is None], self.tokenizer))
        out, at = [], 0
        for ws in words:
            if ws is None:
                out.append(next(whole).tobytes() + last)
            else:
                out.append(b"".join(found[at : at + len(ws)]) + last)
                at += len(ws)
        return out

    def _learn(self, new: set[str]) -> None:
        """Enter the ids of words that are not yet known."""
        known = self._known.now
        unsure = self._unsure(new)
        if unsure:
            known.update((w, x.tobytes()) for w, x in zip(unsure, self._ids(list(unsure), self.tokenizer)))
        # letters are one piece, letters and one mark are two
        ended, letters, mixed = [], set(), []
        for w in new.difference(unsure):
            if w.isalpha():
                letters.add(w)
            elif w[-1] in ENDINGS and w[:-1].isalpha():
                ended.append(w)
            else:
                mixed.append(w)
        parts = self._known.missing({w[:-1] for w in ended} | {w[-1] for w in ended}) - letters
        marks = parts & ENDINGS
        letters |= parts - marks
        mixed += marks.difference(mixed)
        known.update(zip(letters, self._merged(list(letters))))
        known.update(zip(mixed, self._words(mixed)))
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in ended)


def id_width(tokenizer: Tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size(with_added_tokens=True) < 1 << 16 else 4


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system and path for a folder as Spark names it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_tables(docs: DataFrame, path: str, folder: str, end: int = 1) -> DataFrame:
    """Write the ids of ``docs`` (``doc_id, text``) as tables below ``folder``.

    Returns the manifest ``part, file, size, entries, ids, start`` (``start``:
    ids of all documents before the file; a row per file).  Texts are dealt by
    range over (doc_id, hash of the text, place in the input), so that neither a
    repeated doc_id nor a repeated row fills a file, and each task sorts its part and
    encodes it into one file.  A file is written under a name of its own and
    then renamed, so an attempt that is lost or repeated leaves no half file
    under the final name.  Rows without doc_id come first; equal doc_ids stay
    together, ordered by the hashes of their texts.
    """
    width = id_width(Tokenizer.from_file(path))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, = docs.agg(F.sum(F.octet_length("text"))).first()
    parts = int(size or 0) // FILE_BYTES + 1
    # bounds are drawn from these columns, so no text is among them
    order = ["doc_id", "hash", "place"]
    dealt = docs.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = kept(("words", path), lambda: WordEncoder(path)), None
        for batch in batches:
            for b in slices(batch, "text"):
                if table is None:
                    fs, base = file_system(folder)
                    fs.create_dir(base, recursive=True)
                    part = TaskContext.get().partitionId()
                    temporary, name = f"{base}/_{part:08d}-{uuid.uuid4().hex}", f"{base}/part-{part:08d}.sst"
                    stream = fs.open_output_stream(temporary)
                    table = TableWriter(stream, width)
                for d, ids in zip(b.column("doc_id").to_pylist(), encoder.encode_batch([t or "" for t in b.column("text").to_pylist()], end)):
                    table.add(key_of(d), ids)
        if table is not None:
            table.close()
            stream.close()
            fs.move(temporary, name)
            row = {"part": [part], "file": [name], "size": [fs.get_file_info(name).size], "entries": [table.entries], "ids": [table.ids]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("size", pa.int64()), ("entries", pa.int64()), ("ids", pa.int64())]))

    manifest = written(dealt.select("doc_id", "text").mapInArrow(write, "part int, file string, size long, entries long, ids long"), "sst-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_tables(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every entry of the files in the manifest, a task per file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_file(row["file"]) as stream:
                    table, at, rows, held = TableReader(stream, row["size"]), row["start"], [], 0
                    for key, value in table:
                        n = len(value) // table.width
                        ids = value if table.width == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()
                        rows.append((id_of(key), at, n, ids))
                        at, held = at + n, held + len(ids)
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = manifest.select("part", "file", "size", "start")
    last = files.agg(F.max("part")).first()[0]
    return files.repartitionById((last or 0) + 1, F.col("part")).drop("part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def look_up(folder: str, file: str, doc_ids: list[int | None]) -> dict[int | None, list[list[int]]]:
    """Ids of single documents in one file, by filter, block index and one block each."""
    fs, _ = file_system(folder)
    with fs.open_input_file(file) as stream:
        table = TableReader(stream, fs.get_file_info(file).size)
        return {d: [np.frombuffer(v, dtype=f"<u{table.width}").tolist() for v in table.find(d)] for d in doc_ids}


def op8_query(docs: DataFrame, path: str) -> DataFrame:
    """Tables hold every document once; null texts have the end id alone; no rows give none."""
    folder = scratch_path(docs.sparkSession, "sstables")
    back = read_tables(write_tables(docs, path, folder), folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
