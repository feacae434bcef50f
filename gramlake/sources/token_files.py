"""A data source that writes one file per token, ``{token}.proto.bin[.gz]``.

Rows are ``token, second, part`` (``operators.interchange.tree_parts``), sorted
within partitions; the parts of a token are appended to its file as they come,
so the tree of a common token is written without being held.

A task writes below ``_temporary`` under names of its own.  The driver moves
the files of the tasks that Spark accepted to their final names and writes
``statistics.json``; what lost, repeated or failed attempts left goes with
``_temporary``, so no half file ever has a final name.  Its work is bounded by
the vocabulary, not by the model.
"""

from __future__ import annotations

import contextlib
import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gramlake.operators.interchange import joined_parts, tree_parts
from gramlake.sources.scratch import file_system

FORMAT = "gramlake_token_files"
SUFFIX = ".proto.bin"
STATISTICS = "token long, location string, rawbytes long, written long"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: ``(token, temporary name, bytes before and after compression)``."""

    files: list


class TokenFiles(DataSource):
    """``df.write.format(FORMAT).option("path", ...)``; options ``compress`` (true) and ``location``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options["path"], self.options.get("compress", "true") == "true", overwrite)


class _Counted:
    """A stream that counts what goes through it."""

    def __init__(self, out):
        self.out, self.size = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compress: bool, overwrite: bool):
        self.path, self.compress, self.overwrite = path.rstrip("/"), compress, overwrite
        self.job = uuid.uuid4().hex

    def _temporary(self, base: str) -> str:
        return f"{base}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.path)
        folder, files = f"{self._temporary(base)}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        for token, pieces in joined_parts(iterator):
            name = f"{folder}/{token}"
            with fs.open_output_stream(name, compression=None) as stream:
                out, raw = _Counted(stream), 0
                with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") if self.compress else contextlib.nullcontext(out) as packed:
                    for piece in pieces:
                        raw += packed.write(piece)
            files.append((token, name, raw, out.size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.path)
        if self.overwrite:
            old = fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
            for info in old:
                if info.is_file and (SUFFIX in info.base_name or info.base_name == "statistics.json"):
                    fs.delete_file(info.path)
        fs.create_dir(base, recursive=True)
        lines = []
        for token, name, raw, size in (f for m in messages if m for f in m.files):
            final = f"{token}{SUFFIX}{'.gz' if self.compress else ''}"
            fs.move(name, f"{base}/{final}")
            lines.append(json.dumps({"token": token, "location": f"{self.path}/{final}", "rawbytes": raw, "written": size}))
        with fs.open_output_stream(f"{base}/statistics.json") as stream:
            stream.write("".join(line + "\n" for line in sorted(lines)).encode("utf-8"))
        self._forget(fs, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(*file_system(self.path))

    def _forget(self, fs: pyarrow.fs.FileSystem, base: str) -> None:
        if fs.get_file_info(self._temporary(base)).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(self._temporary(base))


def write_model(model: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Write a model as one file per root token, replacing what is at ``path``.

    Returns ``token, location, rawbytes, written`` of every file.
    """
    spark = model.sparkSession
    spark.dataSource.register(TokenFiles)
    parts = tree_parts(model).repartition("token").sortWithinPartitions("token", "second")
    parts.write.format(FORMAT).mode("overwrite").option("compress", str(compress).lower()).save(path)
    return statistics(spark, path)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATISTICS).json(f"{path.rstrip('/')}/statistics.json")
