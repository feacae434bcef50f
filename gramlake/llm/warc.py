"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of several records each,
then two skippable frames: one that maps records to frames,

    magic 0x184D2A50, size, then zstd-packed JSON [[record id, frame, offset, length], ...]

and last the seek table of the public seekable format: compressed and
decompressed size of every frame (4 bytes each), number of frames, a byte of
flags, magic.  Any Zstandard tool unpacks a bundle to plain WARC/1.1; a reader
of single records takes the last bytes, then one frame.

Rows are written by the tasks that hold them: only digests are shuffled where
Spark finds the table of repeated payloads small, otherwise the join by digest
is one that adaptive execution can split at a hot payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import free_name, scratch_path, slices, written
from gramlake.llm.sstable import file_system

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
#: Bytes of records in a frame, of frames in a bundle, and of what a task reads back, about.
FRAME_BYTES, BUNDLE_BYTES, READ_BYTES = 256_000, 512_000_000, 16_000_000
LEVEL = 3
#: Fixed values of the formats.
SEEK_MAGIC, SKIP_SEEK, SKIP_MAP = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
#: The tables have no time of capture.
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return None if page == "none" else int(page)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, date: str = DATE) -> tuple[str, bytes]:
    """Record id and bytes of a record; ``refers_to`` is a 1-tuple of the response's page_id, or None for a response.

    The block is an HTTP response; that of a revisit ends after its header,
    which still states the payload's length.  Blanks and control signs of the
    url are percent-encoded; without url the record's id stands for it.
    """
    digest = digest_of(payload)
    name = record_id(page_id, digest)
    target = name[1:-1] if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to[0], digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block + END


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), block, and where the next record begins."""
    end = data.index(END, at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if data[end + 4 + size : end + 8 + size] != END:
        raise ValueError("a WARC record is cut short")
    return fields, data[end + 4 : end + 4 + size], end + 8 + size


class BundleWriter:
    """Appends records to a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.held, self.size, self.at = [], 0, 0
        self.frames: list[tuple[int, int]] = []
        self.map: list[tuple[str, int, int, int]] = []

    def add(self, name: str, data: bytes) -> None:
        self.map.append((name, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.at += len(packed)
            self.held, self.size = [], 0

    def close(self) -> int:
        """Write the map and the seek table; returns the bundle's size."""
        self._flush()
        packed = self.packer.compress(json.dumps(self.map, separators=(",", ":")).encode("ascii"))
        entries = b"".join(struct.pack("<II", *f) for f in [*self.frames, (len(packed) + 8, 0)])
        table = entries + struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_MAP, len(packed)) + packed + struct.pack("<II", SKIP_SEEK, len(table)) + table)
        return self.at + len(packed) + len(table) + 16


class BundleReader:
    """Reads single frames and records of a bundle; ``stream`` is seekable."""

    def __init__(self, stream, size: int):
        self.stream, self.unpacker = stream, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("not a seekable bundle")
        width = 12 if flags & 0x80 else 8  # with checksums or not
        raw = self._read(size - 9 - n * width, n * width)
        sizes = [struct.unpack_from("<II", raw, i * width) for i in range(n)]
        self.starts = [0]
        for packed, _ in sizes:
            self.starts.append(self.starts[-1] + packed)
        self.frames = n - 1  # the last entry is the map

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def frame(self, n: int) -> bytes:
        return self.unpacker.decompress(self._read(self.starts[n], self.starts[n + 1] - self.starts[n]))

    def map(self) -> list[tuple[str, int, int, int]]:
        raw = self._read(self.starts[-2], self.starts[-1] - self.starts[-2])
        return [tuple(x) for x in json.loads(self.unpacker.decompress(raw[8:]))]

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parsed(self.frame(frame), offset)[:2]


def payload_of(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def with_targets(pages: DataFrame, least: int = LEAST_BYTES) -> tuple[DataFrame, str, str]:
    """``pages`` with two columns: whether a row revisits, and the page_id that it refers to."""
    key, revisits, target, many, own = (free_name(pages, "__warc_" + x) for x in ("key", "revisits", "target", "many", "own"))
    # XXH64 and length beside SHA-1: payloads made to share a SHA-1 digest are still two
    payload = payload_of(F.col("html"))
    digest = F.concat_ws(":", F.sha1(payload), F.xxhash64(payload).cast("string"), F.octet_length(payload).cast("string"))
    keyed = pages.withColumn(key, digest)
    long_enough = F.octet_length(payload_of(F.col("html"))) >= least
    groups = keyed.where(long_enough).groupBy(key).agg(F.max(F.col("page_id").cast("long")).alias(target), F.count("*").alias(many))
    # written first: by its true size Spark decides whether pages have to be shuffled for it
    groups = written(groups.where(F.col(many) > 1).drop(many), "warc-payloads").withColumn(own, F.lit(True))
    joined = keyed.join(groups, key, "left")
    revisit = F.col(own).isNotNull() & ~F.col("page_id").cast("long").eqNullSafe(F.col(target))
    return joined.withColumn(revisits, revisit).drop(key, own), revisits, target


MANIFEST = "file string, size long, first long, frames long"
INDEX = "record_id string, page_id long, file string, frame long, offset long, length long"


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``) below ``folder``; returns the manifest.

    A row of the manifest is a run of frames that is read back at once:
    ``file, size, first, frames``.  The payload is the html in UTF-8 (null:
    empty).  Of rows with equal payloads of at least ``least`` bytes that with
    the largest page_id is a response (a null page_id is the smallest), the
    others revisit it; a row that repeats page_id and payload of a response is
    a response too.  Null urls, empty and very long payloads (a frame of their
    own) are records like any other; other columns are ignored; no rows write
    nothing.  A bundle has a name of its own, which only a finished task puts
    into the manifest, so what a lost attempt left is never read.
    """
    rows, revisits, target = with_targets(pages.select("page_id", "url", "html"), least)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.when(F.col("html").isNotNull(), payload_of(F.col("html"))).alias("payload"), F.col(revisits).alias("revisits"), F.col(target).alias("target"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None

        def finished() -> pa.RecordBatch:
            size = bundle.close()
            bundle.out.close()
            runs, first, held = [], 0, 0
            for n, (_, plain) in enumerate(bundle.frames, 1):
                held += plain
                if held >= READ_BYTES or n == len(bundle.frames):
                    runs.append((first, n - first))
                    first, held = n, 0
            columns = [[name] * len(runs), [size] * len(runs), *map(list, zip(*runs))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for b in slices(batch, "payload"):
                for page_id, url, payload, again, to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisits", "target"))):
                    if bundle is None:
                        fs, base = file_system(folder)
                        fs.create_dir(base, recursive=True)
                        name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                        bundle = BundleWriter(fs.open_output_stream(name, compression=None))
                    bundle.add(*record(page_id, url, payload or b"", (to,) if again else None))
                    if bundle.at >= BUNDLE_BYTES:
                        yield finished()
                        bundle = None
        if bundle is not None:
            yield finished()

    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """Runs of frames, about one a task."""
    return manifest.repartition(max(1, manifest.count()))


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    A response's payload is checked against its digest; a revisit has no html.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for b in batches:
            for run in b.to_pylist():
                with fs.open_input_file(run["file"]) as stream:
                    bundle = BundleReader(stream, run["size"])
                    for n in range(run["first"], run["first"] + run["frames"]):
                        rows = [_row(*x) for x in _records(bundle.frame(n))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _dealt(manifest).mapInArrow(read, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        fields, block, at = parsed(data, at)
        yield fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(END)
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    html = None
    if kind == "response":
        if len(payload) != size or digest_of(payload) != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
        html = payload.decode("utf-8", "replace")
    refers = page_of(fields["warc-refers-to"][1:-1]) if kind == "revisit" else None
    page = fields["warc-record-id"][1:-1]
    url = fields["warc-target-uri"]
    return page_of(page), None if url == page else url, html, size, digest, kind, refers


def record_index(manifest: DataFrame, folder: str) -> DataFrame:
    """``record_id, page_id, file, frame, offset, length`` of every record, from the maps in the bundles."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_file(row["file"]) as stream:
                    found = BundleReader(stream, row["size"]).map()
                    name, frame, offset, length = map(list, zip(*found))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    columns = [name, [page_of(x[1:-1]) for x in name], [row["file"]] * len(name), frame, offset, length]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return _dealt(manifest.select("file", "size").distinct()).mapInArrow(read, INDEX)


def look_up(index: DataFrame, wanted: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Records of ``wanted`` (``record_id``): the fields of ``read_bundles``, from one frame per record."""
    hits = index.join(wanted.select("record_id").distinct(), "record_id").join(manifest.select("file", "size").distinct(), "file")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for b in batches:
            for hit in b.to_pylist():
                with fs.open_input_file(hit["file"]) as stream:
                    row = _row(*BundleReader(stream, hit["size"]).record(hit["frame"], hit["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((hit["record_id"], row[0], row[2], row[5]), kinds)], ["record_id", "page_id", "html", "record_type"])

    return hits.mapInArrow(read, "record_id string, page_id long, html string, record_type string")


def op11_query(pages: DataFrame) -> DataFrame:
    """Archives hold every page once; what is returned comes from them alone.  See ``write_bundles`` for odd rows."""
    folder = scratch_path(pages.sparkSession, "warc")
    back = read_bundles(write_bundles(pages, folder), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
