"""The registered queries of this subpackage, one opN_ for each operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, bytenet, chat, langid, lines, links, packing, rules, tokens, topk


def tokenizer_file(name: str) -> str:
    """A public vocabulary; LODESTONE_TOKENIZERS names another folder that has it."""
    if folder := os.environ.get("LODESTONE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document."""
    found = links.similar_documents(table(spark, sf_dir, "documents"), 80)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents that goes as a copy or near duplicate of an earlier one."""
    return lines.duplicate_lines(table(spark, sf_dir, "documents"), every_line=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    found = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    decoded = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), ranks), ranks)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from four of five folds."""
    held_out = bytenet.fold(F.col("doc_id"), 5) == 0
    scores = bytenet.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.coalesce(held_out, F.lit(False)))
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    held_out = bytenet.fold(F.col("doc_id"), 4) == 2
    found = langid.identify(table(spark, sf_dir, "documents"), F.coalesce(held_out, F.lit(False)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_similar, op3_chat, op4_line_dedup, op5_quality_rules, op6_top_k, op7_token_counts, op8_bpe, op9_quality_classifier, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.ORACLE_SQL, "op6_top_k": topk.ORACLE_SQL}
