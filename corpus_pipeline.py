"""From raw documents to packed training sequences: language ID, near-dedup, secret scan, packing.

Each stage works on all that the one before kept. All but the last return the columns of documents; the last returns the
placed pieces of the documents that remain. Stages take (spark, docs, sf_dir) and return a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, language_id, near_dedup, packing, secret_scan
from siftline.llm.common import Scratch, table

#: A document stays if one language has half of the probability over all of its windows, or as much as labelled texts of
#: its length get.
ENOUGH = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose best language scores lower than labelled texts of their length do.

    Rows with null or empty texts go; rows with null lang or doc_id stay by their text, repeated rows all alike. Where no
    row has a language to learn from, all documents with a letter stay. An empty table stays empty, other columns stay as
    they are. Rows are returned unchanged.
    """
    return language_id.keep_known(docs, language_id.fit(language_id.training_rows(docs)), ENOUGH)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Keeps one document of each group of near-duplicates, one with the smallest doc_id, also where ids repeat or are null.

    Null and empty texts, and texts without a word, all stay: they are near nothing. Of repeated rows one stays. Tables
    may be empty and have other columns. Rows are returned unchanged. The result reads tables that it puts into scratch,
    to be cleared once it is written; without it they last until the driver ends.
    """
    return near_dedup.drop_near_duplicates(docs, scratch=scratch)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark, and sets n_chars to the new length; keeps all rows.

    Null texts stay null, empty ones empty; equal texts change alike. Other columns stay as they are.
    """
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens.

    A null or empty text is one piece of one token; repeated rows are packed once each; pieces of equal length are
    interchangeable. An empty table gives no pieces; other columns play no part.
    """
    return packing.pack(docs, bpe.vocabulary(packing.WORDS))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: SQL has no trained network, no MinHash and no tokenizer; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next; what a stage leaves behind goes once it is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        more = {"scratch": scratch} if stage is one_of_each else {}
        docs = scratch.write(stage(spark, docs, sf_dir, **more), f"stage-{name}")
        scratch.clear(keep=1)
    return docs
