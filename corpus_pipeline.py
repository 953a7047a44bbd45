"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but
the last return the columns of ``documents``.

Edge cases: null texts count as empty; of all empty or blank texts the exact stage keeps one. Rows with
a null ``doc_id`` take part and rank last; rows that repeat an id are decided each by itself. An empty table gives no sequences. Columns beyond
those of ``documents`` are kept until packing, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import discard, materialize, table
from rasterloom.llm.exact_dedup import keep_first
from rasterloom.llm.jaccard_join import keep_one_of_each
from rasterloom.llm.packing import packed_sequences
from rasterloom.llm.span_dedup import remove_repeats
from rasterloom.llm.toxicity import drop_toxic


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal documents."""
    return keep_first(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return keep_one_of_each(docs)


def unrepeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that an earlier document has."""
    return remove_repeats(docs)


def training_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: SentencePiece ids of documents' pieces, with the documents that they are from."""
    return packed_sequences(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", clean_documents),
    ("exact_dedup", distinct_documents),
    ("jaccard_join", dissimilar_documents),
    ("span_dedup", unrepeated_text),
    ("packing", training_sequences),
]

#: Boosted trees and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
