"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
documents with their columns; the last returns the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import mixing, packing, simhash, substrings, toxicity
from attestra.llm.common import materialise, remove, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity grammar rejects.  Null and empty texts stay; repeated rows go or stay
    together."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each SimHash component: op10's rule, three-word shingles and three bits.
    It is no rule of similarity; most near copies that share 0.8 of their five-word shingles stay.  Wordless and
    null texts are one component; documents without an id, and repeated rows of the first, stay."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 13 words and more that a document with a smaller id has.  Every row stays, null texts as they
    are; a null id is the largest."""
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes its words, rounded.  Documents without words are not taken; a
    null source is a source of its own; repeated rows are taken alike."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of each piece of each document; documents without words have no bin, repeated rows one each."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substrings", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned and hashed stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again.  A stage's folder goes when the next is written, the
    last with the result, which is a checkpoint; all of them go if a stage fails.  Empty documents: no rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_path(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove(spark, before)
            before = f"{folder}/{name}"
        return materialise(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, folder)
