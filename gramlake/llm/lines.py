"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import free_name, written

#: A line on more than this share of its host's pages is boilerplate ...
RATIO = 0.02
#: ... if it is on as many pages at least (a copied page alone proves no template).
LEAST_PAGES = 5
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.md5(F.btrim(line, F.lit(BLANKS)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """``host -> keys``: the hashes of the lines that exceed the ratio.

    ``pages`` has ``host, text``.  A page counts once for each of its distinct
    lines, made distinct inside the row; only hashes are shuffled, counted
    before their shuffle, so neither a host with a third of all pages nor a
    line that is on all of them gathers rows in one task.  With ``copies_once``
    the rows of a host that have the same lines are one page.
    """
    keys = F.array_distinct(F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    pages = pages.where("host is not null").select("host", F.array_distinct(F.transform(keys, _key)).alias("keys"))
    if copies_once:
        page = F.md5(F.array_join(F.array_sort("keys"), ""))
        pages = written(pages.groupBy("host", page.alias("page")).agg(F.first("keys").alias("keys")), "line-pages")
    counts = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = written(pages.groupBy("host").agg(F.count("*").alias("pages")), "line-hosts")
    hot = counts.join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
    # at most (lines of a page) / ratio lines of a host can exceed the ratio
    return hot.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """The same rows and columns, ``text`` without its host's boilerplate lines.

    Lines are compared without outer spaces, tabs and carriage returns; blank
    lines are neither counted nor dropped.  A null text stays null, a text of
    dropped lines only becomes empty, the rows of a null host stay as they
    are, and repeated rows are pages of their own unless ``copies_once``.  No
    row is ever dropped.
    """
    found = written(boilerplate(docs.select(F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text")), ratio, least, copies_once), "line-keys")
    own, hot = (free_name(docs, "__line_" + x) for x in ("host", "keys"))
    joined = docs.join(found.select(F.col("host").alias(own), F.col("keys").alias(hot)), docs[host].cast("string") == F.col(own), "left")
    lines = _lines(docs[text].cast("string"))
    kept = F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains(F.col(hot), _key(x)))
    cleaned = F.when(F.col(hot).isNull() | docs[text].isNull(), docs[text].cast("string")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[cleaned.alias(c) if c == text else docs[c] for c in docs.columns])


def op10_query(docs: DataFrame) -> DataFrame:
    """Every document with its cleaned text and its length in characters before and after."""
    docs = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    out = drop_boilerplate(docs.withColumn("n_before", F.length("text").cast("long")))
    return out.select("doc_id", "text", "n_before", F.length("text").cast("long").alias("n_after"))
