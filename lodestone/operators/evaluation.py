"""Retrieval and answer evaluation by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

TOLERANCE = 5


def doc_matches(title: Column, gold: Column) -> Column:
    return F.contains(F.lower(title), F.lower(gold))


def page_matches(first: Column, last: Column, gold_first: Column, gold_last: Column) -> Column:
    """Pages within the gold range or TOLERANCE pages around it; without a range every page matches."""
    return F.when(gold_first.isNull(), True).when(first.isNull(), False).otherwise((first <= gold_last + TOLERANCE) & (F.coalesce(last, first) >= gold_first - TOLERANCE))


def page_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.coalesce(F.greatest(a, c) <= F.least(F.coalesce(b, a), F.coalesce(d, c)), F.lit(False))


def first_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """The first matching rank by document and by document and page: case columns, doc_rank, page_rank.

    Cases have q_id, gold_doc, gold_first, gold_last; hits have q_id, rank, document_title and pages.
    """
    match = doc_matches(F.col("document_title"), F.col("gold_doc"))
    page = match & page_matches(F.col("page_start"), F.col("page_end"), F.col("gold_first"), F.col("gold_last"))
    ranks = hits.join(cases.select("q_id", "gold_doc", "gold_first", "gold_last"), "q_id").groupBy("q_id").agg(F.min(F.when(match, F.col("rank"))).alias("doc_rank"), F.min(F.when(page, F.col("rank"))).alias("page_rank"))
    return cases.join(ranks, "q_id", "left")


def keyword_hits(cases: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """Whether the first hits' texts hold any of a case's keywords: q_id, keyword_hit."""
    found = hits.where(F.col("rank") <= most).join(cases.select("q_id", "keywords"), "q_id")
    hit = F.exists("keywords", lambda k: F.contains(F.lower("text"), F.lower(k)))
    return found.groupBy("q_id").agg(F.max(hit).alias("keyword_hit"))


def ndcg(rank: Column, k: int = 5) -> Column:
    return F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def metrics(results: DataFrame, *by: str) -> DataFrame:
    """Means over cases with doc_rank, page_rank and keyword_hit."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    doc, page = F.col("doc_rank"), F.col("page_rank")
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), rate(doc == 1).alias("hit_at_1"), rate(doc <= 3).alias("hit_at_3"), rate(doc <= 5).alias("hit_at_5"),
        F.round(F.avg(F.coalesce(1.0 / doc, F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(F.coalesce(ndcg(doc), F.lit(0.0))), 4).alias("ndcg_at_5"), rate(page <= 5).alias("page_hit_at_5"), rate(F.col("keyword_hit")).alias("keyword_hit_rate"),
    )


def answer_overlap(prediction: Column, gold: Column) -> Column:
    """Common distinct tokens over the geometric mean of both numbers of tokens."""
    tokens = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(T.SINGLE_TOKEN), 0), F.lower))
    a, b = tokens(prediction), tokens(gold)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double")))


def citation_score(sources: Column, gold: Column, title: Column) -> Column:
    whole = F.lower(F.array_join(sources, " "))
    exact = F.when(F.size(gold) > 0, F.size(F.filter(gold, lambda g: F.contains(whole, F.lower(g)))) / F.size(gold)).otherwise(0.0)
    return F.when(F.size(sources) == 0, 0.0).when((title != "") & F.contains(whole, F.lower(title)), F.greatest(exact, F.lit(0.7))).otherwise(exact)


def grade() -> Column:
    """A hit's grade over its rank: gold chunk 1, document and page .7, document and section .5, document .2."""
    same_doc = F.lower("document_title") == F.lower("gold_title")
    same_page = page_overlap(F.col("page_start"), F.col("page_end"), F.col("gold_first"), F.col("gold_last"))
    same_section = (F.col("gold_section") != "") & (F.lower("section_title") == F.lower("gold_section"))
    value = F.when(F.col("chunk_id") == F.col("gold_chunk"), 1.0).when(same_doc & same_page, 0.7).when(same_doc & same_section, 0.5).when(same_doc, 0.2).otherwise(0.0)
    return value / F.col("rank")


def retrieval_scores(cases: DataFrame, hits: DataFrame) -> DataFrame:
    best = hits.join(cases.select("q_id", "gold_chunk", "gold_title", "gold_section", "gold_first", "gold_last"), "q_id").groupBy("q_id").agg(F.max(grade()).alias("retrieval"))
    return cases.select("q_id").join(best, "q_id", "left").select("q_id", F.coalesce("retrieval", F.lit(0.0)).alias("retrieval"))


def passed(retrieval: Column, citation: Column, answer: Column) -> Column:
    return (retrieval > 0) & (citation >= 0.5) & (answer >= 0.15)


def recall_diagnosis(cases: DataFrame, hits: DataFrame, top_k: int = 6) -> DataFrame:
    """By case: gold_rank, nearby_rank and status."""
    joined = hits.join(cases.select("q_id", "gold_chunk", "gold_title", "gold_section", "gold_first", "gold_last"), "q_id")
    same_doc = F.lower("document_title") == F.lower("gold_title")
    near = same_doc & (page_overlap(F.col("page_start"), F.col("page_end"), F.col("gold_first"), F.col("gold_last")) | ((F.col("gold_section") != "") & (F.lower("section_title") == F.lower("gold_section"))))
    ranks = joined.groupBy("q_id").agg(F.min(F.when(F.col("chunk_id") == F.col("gold_chunk"), F.col("rank"))).alias("gold_rank"), F.min(F.when(near, F.col("rank"))).alias("nearby_rank"))
    status = F.when(F.col("gold_rank") <= top_k, "exact_top_k").when(F.col("gold_rank").isNotNull(), "rerank_opportunity").when(F.col("nearby_rank").isNotNull(), "nearby_only").otherwise("recall_failure")
    return cases.select("q_id").join(ranks, "q_id", "left").withColumn("status", status)


def recall_summary(diagnosed: DataFrame) -> DataFrame:
    share = lambda s: F.round(F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)), 4).alias(f"{s}_rate")
    return diagnosed.agg(F.count("*").alias("case_count"), *map(share, ("exact_top_k", "rerank_opportunity", "nearby_only", "recall_failure")), F.median("gold_rank").alias("median_gold_rank"))


def seeded_cases(chunks: DataFrame, limit: int) -> DataFrame:
    """A stratified draw of chunks: of each title no more than twice its share, in the order of a hash.

    The order is a fixed hash's, so that the draw is the same everywhere.
    """
    titles = chunks.select("document_title").distinct().count()
    cap = max(2, -(-limit // max(1, titles)))
    lot = F.md5(F.concat(F.lit("42:"), "chunk_id"))
    drawn = chunks.withColumn("lot", lot).withColumn("nth", F.row_number().over(Window.partitionBy("document_title").orderBy("lot"))).where(F.col("nth") <= cap)
    return drawn.orderBy("lot").limit(limit)


def model_score(latency: Column, citations: Column, length: Column) -> Column:
    speed = F.greatest(F.lit(0.0), F.least(F.lit(20.0), 20 * (1 - (latency - 2000) / 3000)))
    size = F.when(length < 500, F.least(F.lit(20.0), length / 25)).otherwise(F.greatest(F.lit(0.0), 20 - (length - 500) / 100))
    return citations * 60 + speed + size
