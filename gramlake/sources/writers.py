"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.functions import wire
from gramlake.functions.language import Language
from gramlake.operators.prefixes import prefixes


def replace_table(df: DataFrame, name: str) -> None:
    """Replace the rows of a table that must exist already."""
    if not df.sparkSession.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
    df.write.insertInto(name, overwrite=True)


def text_lines(df: DataFrame, path: str, column: str = "line", compression: str | None = None) -> None:
    df.select(column).write.mode("overwrite").text(path, compression=compression)


def json_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").json(path, compression=compression)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def model_by_root(model: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Write a model partitioned by the token its prefixes end in, so lookups read one part.

    Returns ``root, rows, rawbytes``: what each part holds.
    """
    kind = prefixes(model)
    name = kind.root("prefix").cast("string") if kind.tokens else F.hex(kind.root("prefix"))
    rows = model.withColumn("part", F.when(F.col("k") > 0, name).otherwise(F.lit("")))
    # hashed beforehand by root and prefix: parts of common tokens are written by several tasks
    rows.repartition("part", F.xxhash64("prefix") % 8).write.mode("overwrite").partitionBy("part").option("compression", "zstd" if compress else "none").parquet(path)
    return part_stats(model)


def part_stats(model: DataFrame) -> DataFrame:
    kind = prefixes(model)
    rows = model.where("k > 0").withColumn("root", kind.root("prefix"))
    held = 4 * F.col("k") + 4 if kind.tokens else F.octet_length("prefix") + F.octet_length("successor")
    return rows.groupBy("root").agg(F.count("*").alias("rows"), F.sum(held + 8).alias("rawbytes"))


def binary_file(spark: SparkSession, path: str, data: bytes, compress: bool = True) -> str:
    """Write one file of bytes through Spark's file systems; gzipped and named .gz if ``compress``. Returns its path."""
    if compress or path.endswith(".gz"):
        data = wire.zipped(data)
    if compress and not path.endswith(".gz"):
        path += ".gz"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(data)
    finally:
        stream.close()
    return path


def language(spark: SparkSession, lang: Language, path: str, compress: bool = True) -> str:
    return binary_file(spark, path, lang.to_bytes(), compress)


def generated_text(df: DataFrame, path: str, column: str = "text") -> None:
    """Write short generated texts from the driver (``-`` prints them)."""
    for row in df.select(column).toLocalIterator():
        if path == "-":
            print(row[0])
        else:
            with open(path, "a", encoding="utf-8") as f:
                f.write(row[0] + "\n")
