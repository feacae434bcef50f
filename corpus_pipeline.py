"""Corpus preparation: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramlake.llm import bpe, lines, mixing, registry, simhash, toxicity
from gramlake.llm.common import adopt, scratch_path, scratch_scope, table


#: Options of the near-dedup stage.
NEAR = {"shingle": 5, "budget": 8, "second": True}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the field is fitted on the labels of those documents.

    Null and empty texts, rows without doc_id and repeated rows stay unless
    their text is toxic; an empty table or one without labels loses nothing.
    """
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the boilerplate lines of their source; no document goes.

    Copies are still there at this stage, so they count as one page: a text is
    no template of its source because it was copied often.  Rows of a null
    source and null texts stay as they are.
    """
    return lines.drop_boilerplate(docs, copies_once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-copies one stays.

    Five-word shingles and up to eight differing bits of 64 (an estimated
    cosine of 0.92), checked by a second fingerprint.  All such links are
    found: fingerprints meet where two or more of the blocks agree.  Texts
    without words are copies of each other; rows that share a doc_id are one
    document; rows without doc_id stay.
    """
    return simhash.simhash_dedup(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources have their target words.

    A null source is one of its own; texts without words follow their hash.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digest of what they decode to; a null text has no ids."""
    return bpe.op2_query(docs, registry.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: A trained field decides the first stage and XXH64 the third; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage wrote is removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        with scratch_scope(spark) as keep:
            if before:
                adopt(before)
            before = scratch_path(spark, f"pipeline-{n}")
            keep.add(before)
            made = stage(spark, docs, sf_dir)
            made.write.parquet(before)
        docs = spark.read.schema(made.schema).parquet(before)
    return docs
