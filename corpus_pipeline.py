"""A training-data pipeline over documents: rejection, line and document deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bytenet, langid, lines, links, packing
from lodestone.llm.entry import table, tokenizer_file
from lodestone.llm.shared import removed, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, predicts to be good."""
    return bytenet.without_rejected(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus is labelled with."""
    return langid.with_a_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of earlier lines, short ones included, and near duplicates of longer ones."""
    return lines.without_duplicate_lines(docs, every_line=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return links.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("language_id", language), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_copies), ("packing", packed)]

#: Learned models and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again as the next one's documents.

    A stage's table is removed once the next one's is written.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
