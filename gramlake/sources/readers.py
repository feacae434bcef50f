"""Sources.  Paths are any that Spark's file systems know (local, s3a://, gs://, hdfs://)."""

from __future__ import annotations

import codecs
import gzip
import io
import json
import lzma
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions.language import Language

#: Bytes that are unpacked, and characters that are handed on, at once.
STEP = 1 << 20
#: Fields of an article file.
ARTICLE = "id string, title string, text string"
#: Fields of a segment table.
SEGMENT = "num_segments int, block_size int, segment string"
#: Fields of a table of tokenized texts.
TOKENIZED = "id string, encoded array<int>"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file is one text; .gz and other codecs by suffix."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, data``: bytes of each file, unpacked if its name ends in .gz."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = [gzip.decompress(c) if p.endswith(".gz") else c for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame({"path": frame["path"], "data": data})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, data binary")


def text_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """``line``: files by glob; .bz2, .deflate, .gz and .zst by Spark's codecs, .xz and .lzma unpacked here.

    Files of all kinds may be mixed; each is read after its name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    kinds = [k for k in ("*.xz", "*.lzma") if files.option("pathGlobFilter", k).load(pattern).select("path").take(1)]
    packed = [xz_lines(spark, pattern, glob=k) for k in kinds]
    plain = spark.read.option("recursiveFileLookup", "true").text(pattern).where(~F.col("_metadata.file_name").rlike(r"\.(xz|lzma)$"))
    return reduce(DataFrame.union, packed, plain.select(F.col("value").alias("line")))


def _texts(content: bytes, opened: Callable) -> Iterator[str]:
    """A packed file's text in parts of about STEP characters; bytes that are no UTF-8 raise."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    with opened(io.BytesIO(content)) as stream:
        while data := stream.read(STEP):
            yield decoder.decode(data)
    yield decoder.decode(b"", final=True)


def _lines(parts: Iterator[str]) -> Iterator[list[str]]:
    """Lines of a text that comes in parts; a line may be longer than a part."""
    held: list[str] = []
    for part in parts:
        first, *rest = part.split("\n")
        held.append(first)
        if rest:
            yield ["".join(held), *rest[:-1]]
            held = [rest[-1]]
    if any(held):
        yield ["".join(held)]


def _whole(content: bytes, opened: Callable) -> str | None:
    """What is wrong with a packed file, if anything; it is unpacked once, and nothing is kept."""
    try:
        for _ in _texts(content, opened):
            pass
    except (lzma.LZMAError, UnicodeDecodeError, EOFError, OSError, zlib.error) as e:
        return f"{type(e).__name__}: {e}"
    return None


def xz_lines(spark: SparkSession, pattern: str, skip_bad: bool = True, glob: str = "*") -> DataFrame:
    """Lines of .xz or .lzma files; a file that cannot be unpacked is left out (or raises).

    Files are unpacked a part at a time, so a task holds a file as it is stored
    and about a megabyte of its text.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                if skip_bad and _whole(content, lzma.open):
                    continue
                for lines in _lines(_texts(content, lzma.open)):
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(pattern)
    return files.select("content").mapInArrow(unpack, "line string")


def xz_report(spark: SparkSession, pattern: str, glob: str = "*") -> DataFrame:
    """``path, lines, characters, error`` of packed files: what ``xz_lines`` reads of each, and why it skips one."""
    names, kinds = ["path", "lines", "characters", "error"], [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                error, lines, size = _whole(content, lzma.open), 0, 0
                for part in _lines(_texts(content, lzma.open)) if error is None else ():
                    lines += len(part)
                    size += sum(map(len, part))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((path, lines, size, error), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(pattern)
    return files.select("path", "content").mapInArrow(look, "path string, lines long, characters long, error string")


def table_rows(spark: SparkSession, name: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A table, or a query of some columns and rows; both are pushed to the source."""
    rows = spark.read.table(name)
    rows = rows.select(*columns) if columns else rows
    return rows.limit(limit) if limit is not None else rows


def parquet_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, compressed or not."""
    return spark.read.schema(schema).json(path)


def in_memory(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, length`` of the files below a prefix or glob; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    return files.select("path", "length")


def _items(parts: Iterator[str]) -> Iterator[object]:
    """The items of one JSON array that comes in parts; anything else raises.

    More is read only while an item is not whole, twice as much each time, so
    about two items are held.
    """
    decoder, text, at = json.JSONDecoder(), "", 0

    def more(least: int) -> bool:
        """Read on by so many characters at least; what is behind goes."""
        nonlocal text, at
        fresh = []
        while least > 0 and (part := next(parts, None)) is not None:
            fresh.append(part)
            least -= len(part)
        if fresh:
            text, at = text[at:] + "".join(fresh), 0
        return bool(fresh)

    def ahead() -> str:
        """The next character that is not blank, not taken; nothing at the end."""
        nonlocal at
        while True:
            while at < len(text) and (text[at].isspace() or text[at] == "\ufeff"):
                at += 1
            if at < len(text) or not more(1):
                return text[at : at + 1]

    if ahead() != "[":
        raise ValueError("no JSON array")
    at += 1
    mark = ahead()
    while mark != "]":
        if not ahead():
            raise ValueError("the array does not end")
        while True:
            try:
                item, end = decoder.raw_decode(text, at)
                # what is not yet followed by a mark may go on in the next part, as numbers do
                if text[end : end + 1].isspace() or text[end : end + 1] in (",", "]") or not more(1):
                    break
            except json.JSONDecodeError:
                if not more(len(text) - at):
                    raise
        at = end
        yield item
        mark = ahead()
        if mark not in (",", "]"):
            raise ValueError("items of the array are not parted")
        at += mark == ","
    at += 1
    if ahead():
        raise ValueError("something follows the array")


def article_files(spark: SparkSession, pattern: str, skip_bad: bool = False) -> DataFrame:
    """``src, id, title, text``: JSON files that hold one array of articles each, gzipped or not.

    Arrays are read an article at a time; a file that is no such array raises,
    or is left out whole.  Fields that are no text are given as JSON.
    """
    names = [c.split()[0] for c in ARTICLE.split(", ")]

    def text(value: object) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def items(content: bytes) -> Iterator[object]:
        return _items(_texts(content, gzip.open if content[:2] == b"\x1f\x8b" else lambda stream: stream))

    def bad(content: bytes) -> bool:
        try:
            return not all(isinstance(x, dict) for x in items(content))
        except (ValueError, EOFError, OSError, zlib.error):
            return True

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = [[path] * len(held), *([text(x.get(n)) for x in held] for n in names)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["src", *names])

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if skip_bad and bad(content):
                    continue
                held, size = [], 0
                for item in items(content):
                    held.append(item)
                    size += len(item.get("text") or "") if isinstance(item.get("text"), str) else 0
                    if len(held) >= 1000 or size >= STEP:
                        yield made()
                        held, size = [], 0
                if held:
                    yield made()

    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", "content").mapInArrow(read, f"src string, {ARTICLE}")


def language(spark: SparkSession, path: str) -> Language:
    """A language from a file: JSON, or a protocol buffer message, either gzipped or not."""
    (row,) = binary_files(spark, path).select("data").collect()
    data = bytes(row[0])
    if path.removesuffix(".gz").endswith(".json"):
        return Language.from_json(data.decode("utf-8"), path)
    return Language.from_bytes(data)


def trees(spark: SparkSession, path: str, compressed: bool = True) -> DataFrame:
    """``k, prefix, successor, n`` of files that hold one serialized tree each."""
    from gramlake.operators import interchange

    return interchange.tree_rows(spark.read.format("binaryFile").load(path).select(F.col("content").alias("tree")), compressed)


def model(spark: SparkSession, path: str) -> DataFrame:
    """A model written by ``writers.model_by_root``."""
    return spark.read.parquet(path).select("k", "prefix", "successor", "n")


def url_parts(url):
    """``bucket, key`` of ``scheme://bucket/key`` as columns."""
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]+)/(.*)$", 1), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]+)/(.*)$", 2)
    return F.struct(rest[0].alias("bucket"), rest[1].alias("key"))
