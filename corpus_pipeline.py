"""A corpus pipeline of five stages, each calling one operator of chunkloom.llm on all that its predecessor kept.

run(spark, sf_dir) applies STAGES to the documents table; every stage's result is written to the shared folder and
read again. All stages but the last return the columns of documents, whatever further ones there are and whatever their
names. Every stage takes an empty table and returns an empty one. The stages bound the bytes of the session's Arrow
batches: executors and workers hold a few megabytes of texts at once, however long they are and however many a file has.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm.common import bound_batches, materialize, table
from chunkloom.llm.exact_dedup import keep_one
from chunkloom.llm.jaccard_join import keep_one_of_each
from chunkloom.llm.langid import keep_languages
from chunkloom.llm.packing import pack_documents
from chunkloom.llm.suffix_dedup import strip_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go (no letter, or bytes that no language's model codes).

    Null and empty texts have no letter and go; equal texts stay or go together; without any labelled row all texts
    that have a letter stay; a null lang or id is no reason to go.
    """
    bound_batches(spark)
    return keep_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the one with the largest id stays.

    Null equals empty; of rows with the same id and text one stays; a null id loses to any other.
    """
    bound_batches(spark)
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without words are in no group and stay; of rows with the same smallest id one stays; a null id stays only in a
    group without any other.
    """
    bound_batches(spark)
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand elsewhere too are cut out of the texts; n_chars follows.

    Every row stays; a null text stays null, and one that is all repeated passages becomes empty.
    """
    bound_batches(spark)
    return strip_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens; a null or empty text is its end-of-document id alone."""
    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Language models, byte-level cuts and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
