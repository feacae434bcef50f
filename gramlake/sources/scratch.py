"""Tables that a computation writes for itself, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Scratch paths that this process has given out.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            root = current.rsplit("/", 1)[0]
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="gramlake-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: later steps, and lost executors, start from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def remove_made() -> None:
    """Remove the scratch tables of this process; its end does so too.  What a lazy result still reads goes with them."""
    while _made:
        with contextlib.suppress(OSError, ValueError):  # gone already, or a store that Arrow does not reach
            fs, path = file_system(_made.pop())
            fs.delete_dir(path)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system and path for a folder as Spark names it."""
    for alias in ("s3a://", "s3n://"):
        uri = uri.replace(alias, "s3://", 1) if uri.startswith(alias) else uri
    return pyarrow.fs.FileSystem.from_uri(uri)
