"""Queries of evaluation; the hits are the nearest vectors' first chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as E
from lodestone.plans import sql as S
from lodestone.plans.base import cases, chunks, read, vector_hits


def _ranked(spark, sf_dir, k=10):
    return E.first_ranks(cases(spark, sf_dir), vector_hits(spark, sf_dir, k))


def _results(spark, sf_dir, k=10):
    hits = vector_hits(spark, sf_dir, k)
    told = cases(spark, sf_dir)
    return E.first_ranks(told, hits).join(E.keyword_hits(told, hits), "q_id", "left").withColumn("keyword_hit", F.coalesce("keyword_hit", F.lit(False)))


def first_ranks(spark, sf_dir):
    return _ranked(spark, sf_dir).select("q_id", "doc_rank", "page_rank")


def metrics(spark, sf_dir):
    return E.metrics(_results(spark, sf_dir))


def keyword_hits(spark, sf_dir):
    return _results(spark, sf_dir).select("q_id", "keyword_hit")


def failures(spark, sf_dir):
    """Questions without their document among the first five, with the different titles found."""
    titles = vector_hits(spark, sf_dir, 10).groupBy("q_id").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document_title"))), lambda x: x["document_title"])), ", ").alias("titles"))
    return _ranked(spark, sf_dir).where("doc_rank is null or doc_rank > 5").join(titles, "q_id").select("q_id", "titles")


def answer_overlap(spark, sf_dir):
    first = vector_hits(spark, sf_dir, 1).select("q_id", "text")
    return cases(spark, sf_dir).join(first, "q_id").select("q_id", F.round(E.answer_overlap(F.col("text"), F.col("question")), 6).alias("overlap"))


def _judged(spark, sf_dir):
    hits, told = vector_hits(spark, sf_dir, 6), _graded_cases(spark, sf_dir)
    cited = hits.groupBy("q_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", T.citation(F.col("document_title"), F.col("page_start"), F.col("page_end")).alias("c")))), lambda x: x["c"]).alias("sources"), F.min_by("text", "rank").alias("answer"))
    gold = F.array(T.citation(F.col("gold_title"), F.col("gold_first"), F.col("gold_last")))
    rows = told.join(cited, "q_id").join(E.retrieval_scores(told, hits), "q_id")
    return rows.select("q_id", "retrieval", E.citation_score(F.col("sources"), gold, F.col("gold_title")).alias("citation"), E.answer_overlap(F.col("answer"), F.col("question")).alias("answer"))


def _graded_cases(spark, sf_dir):
    return cases(spark, sf_dir).withColumn("gold_first", F.col("g_first")).withColumn("gold_last", F.col("g_last")).where("gold_title is not null")


def citation_scores(spark, sf_dir):
    return _judged(spark, sf_dir).select("q_id", F.round("citation", 6).alias("citation"))


def retrieval_scores(spark, sf_dir):
    return E.retrieval_scores(_graded_cases(spark, sf_dir), vector_hits(spark, sf_dir, 20)).select("q_id", F.round("retrieval", 6).alias("retrieval"))


def eval_run(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    ok = E.passed(F.col("retrieval"), F.col("citation"), F.col("answer"))
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(f"{c}_mean") for c in ("retrieval", "citation", "answer")), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 4).alias("pass_rate"))


def recall_diagnosis(spark, sf_dir):
    return E.recall_diagnosis(_graded_cases(spark, sf_dir), vector_hits(spark, sf_dir, 50))


def recall_summary(spark, sf_dir):
    return E.recall_summary(recall_diagnosis(spark, sf_dir))


def seeded_cases(spark, sf_dir):
    rows = chunks(spark, sf_dir).where("chunk_level = 'paragraph'")
    return E.seeded_cases(rows, 200).select("chunk_id", "document_title")


def gold_repair(spark, sf_dir):
    """The chunk of the gold chunk's document that shares more of the question's words, by at least .05."""
    told = _graded_cases(spark, sf_dir).select("q_id", "question", "gold_chunk", F.regexp_extract("gold_chunk", "^(.*)-", 1).alias("doc"))
    pieces = chunks(spark, sf_dir).where("chunk_level = 'paragraph'").select("chunk_id", "doc_id", "text")
    rows = told.join(pieces, F.col("doc") == F.col("doc_id").cast("string")).withColumn("overlap", F.round(E.answer_overlap(F.col("text"), F.col("question")), 9))
    best = rows.groupBy("q_id", "gold_chunk").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "chunk_id")).alias("best"), F.max(F.when(F.col("chunk_id") == F.col("gold_chunk"), F.col("overlap"))).alias("own"))
    better = (-F.col("best.less")) - F.col("own") >= 0.05
    return best.select("q_id", F.when(better, F.col("best.chunk_id")).otherwise(F.col("gold_chunk")).alias("gold_chunk"), better.alias("repaired"))


def candidate_sweep(spark, sf_dir):
    """The metrics with the first 5, 10, 20 and 40 candidates."""
    told, hits = cases(spark, sf_dir), vector_hits(spark, sf_dir, 40)
    sizes = spark.createDataFrame([(k,) for k in (5, 10, 20, 40)], "candidates int")
    ranks = E.first_ranks(told, hits).select("q_id", "doc_rank").crossJoin(F.broadcast(sizes))
    found = F.when(F.col("doc_rank") <= F.col("candidates"), F.col("doc_rank"))
    return ranks.groupBy("candidates").agg(F.round(F.avg(F.when(found.isNotNull(), 1.0).otherwise(0.0)), 4).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / found, F.lit(0.0))), 4).alias("mrr"))


def regression_gate(spark, sf_dir):
    rows = E.metrics(_results(spark, sf_dir))
    checks = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(least).alias("least")) for c, least in (("hit_at_5", 0.95), ("mrr", 0.85), ("page_hit_at_5", 0.90))))
    return rows.select(F.explode(checks).alias("c")).select("c.metric", "c.value", "c.least", (F.col("c.value") >= F.col("c.least")).alias("passed"))


def model_scores(spark, sf_dir):
    """Event types are models here, their values latencies."""
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.col("value") * 100).alias("latency"), F.avg(F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0)).alias("cited"), F.avg(F.col("user_id") * 3.0).alias("length"))
    return rows.select("event_type", F.round(E.model_score(F.col("latency"), F.col("cited"), F.col("length")), 4).alias("score"))


def thresholds(spark, sf_dir):
    """What is weak in a run, and the run's grade."""
    row = eval_run(spark, sf_dir)
    weak = F.array_compact(F.array(F.when(F.col("retrieval_mean") < 0.65, "retrieval"), F.when(F.col("answer_mean") < 0.30, "answer"), F.when(F.col("citation_mean") < 0.50, "citation")))
    grade = F.when(F.col("pass_rate") >= 0.8, "excellent").when(F.col("pass_rate") >= 0.7, "good").when(F.col("pass_rate") >= 0.6, "acceptable").otherwise("to improve")
    return row.select(F.array_join(weak, ",").alias("weak"), grade.alias("grade"))


def answer_keywords(spark, sf_dir):
    told, hits = cases(spark, sf_dir), vector_hits(spark, sf_dir, 1)
    hit = F.exists("keywords", lambda k: F.contains(F.lower("text"), k))
    return told.join(hits.select("q_id", "text"), "q_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 4).alias("rate"))


def previews(spark, sf_dir):
    rows = vector_hits(spark, sf_dir, 1)
    return rows.select("q_id", "chunk_id", "document_title", F.round(1 - F.col("distance"), 4).alias("score"), F.substring(T.squeeze(F.col("text")), 1, 180).alias("snippet"))


_RANKS = f"""{S.VECTOR_HITS}, ranks AS (SELECT c.q_id, c.keywords, c.question,
  min(CASE WHEN contains(lower(h.document_title), c.gold_doc) THEN h.rank END) AS doc_rank,
  coalesce(bool_or(h.rank <= 5 AND len(list_filter(c.keywords, lambda k: contains(lower(h.text), k))) > 0), FALSE) AS keyword_hit
  FROM cases c LEFT JOIN vhits h ON h.q_id = c.q_id AND h.rank <= 10 GROUP BY ALL)"""
_RATE = "round(avg(CASE WHEN {0} THEN 1e0 ELSE 0e0 END), 4)"
_METRICS = f"""SELECT count(*) AS n, {_RATE.format("doc_rank = 1")} AS hit_at_1, {_RATE.format("doc_rank <= 3")} AS hit_at_3, {_RATE.format("doc_rank <= 5")} AS hit_at_5,
  round(avg(coalesce(1e0 / doc_rank, 0)), 4) AS mrr, round(avg(CASE WHEN doc_rank <= 5 THEN 1e0 / log2(doc_rank + 1) ELSE 0 END), 4) AS ndcg_at_5, {_RATE.format("doc_rank <= 5")} AS page_hit_at_5, {_RATE.format("keyword_hit")} AS keyword_hit_rate FROM ranks"""
_TOK = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+|[一-鿿]'), lambda x: lower(x)))"
_OVERLAP = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0e0 ELSE len(list_intersect({0}, {1})) / sqrt(CAST(len({0}) * len({1}) AS DOUBLE)) END".format(_TOK.format("{0}"), _TOK.format("{1}"))
_CITE = "{0} || ' p.' || CASE WHEN {1} = {2} THEN CAST({1} AS VARCHAR) ELSE {1} || '-' || {2} END"
_GRADE = """max(CASE WHEN h.chunk_id = c.gold_chunk THEN 1e0 WHEN h.document_title = c.gold_title AND greatest(h.page_start, c.g_first) <= least(h.page_end, c.g_last) THEN 0.7e0
  WHEN h.document_title = c.gold_title AND c.gold_section <> '' AND lower(h.section_title) = lower(c.gold_section) THEN 0.5e0 WHEN h.document_title = c.gold_title THEN 0.2e0 ELSE 0e0 END / h.rank)"""
_JUDGED = f"""{S.VECTOR_HITS}, g AS (SELECT * FROM cases WHERE gold_title IS NOT NULL),
j AS (SELECT c.q_id, any_value(c.question) AS question, coalesce({_GRADE}, 0) AS retrieval, lower(string_agg({_CITE.format("h.document_title", "h.page_start", "h.page_end")}, ' ' ORDER BY h.rank)) AS whole,
  any_value(lower({_CITE.format("c.gold_title", "c.g_first", "c.g_last")})) AS gold_cite, any_value(lower(c.gold_title)) AS gold_title, min_by(h.text, h.rank) AS answer_text
  FROM g c JOIN vhits h ON h.q_id = c.q_id AND h.rank <= 6 GROUP BY c.q_id),
judged AS (SELECT q_id, retrieval, CASE WHEN contains(whole, gold_cite) THEN 1e0 WHEN contains(whole, gold_title) THEN 0.7e0 ELSE 0e0 END AS citation, {_OVERLAP.format("answer_text", "question")} AS answer FROM j),
run AS (SELECT count(*) AS n, round(avg(retrieval), 4) AS retrieval_mean, round(avg(citation), 4) AS citation_mean, round(avg(answer), 4) AS answer_mean, {_RATE.format("retrieval > 0 AND citation >= 0.5 AND answer >= 0.15")} AS pass_rate FROM judged)"""
_DIAG = f"""{S.VECTOR_HITS}, r AS (SELECT c.q_id, min(CASE WHEN h.chunk_id = c.gold_chunk THEN h.rank END) AS gold_rank,
  min(CASE WHEN h.document_title = c.gold_title AND (greatest(h.page_start, c.g_first) <= least(h.page_end, c.g_last) OR c.gold_section <> '' AND lower(h.section_title) = lower(c.gold_section)) THEN h.rank END) AS nearby_rank
  FROM cases c LEFT JOIN vhits h ON h.q_id = c.q_id AND h.rank <= 50 WHERE c.gold_title IS NOT NULL GROUP BY c.q_id),
diag AS (SELECT *, CASE WHEN gold_rank <= 6 THEN 'exact_top_k' WHEN gold_rank IS NOT NULL THEN 'rerank_opportunity' WHEN nearby_rank IS NOT NULL THEN 'nearby_only' ELSE 'recall_failure' END AS status FROM r)"""

QUERIES = {
    "e01_first_ranks": (first_ranks, f"WITH {_RANKS} SELECT q_id, doc_rank, doc_rank AS page_rank FROM ranks"),
    "e02_metrics": (metrics, f"WITH {_RANKS} {_METRICS}"),
    "e03_keyword_hits": (keyword_hits, f"WITH {_RANKS} SELECT q_id, keyword_hit FROM ranks"),
    "e04_failures": (
        failures,
        f"WITH {_RANKS} SELECT q_id, titles FROM ranks JOIN (SELECT q_id, string_agg(document_title, ', ' ORDER BY first_) AS titles FROM (SELECT q_id, document_title, min(rank) AS first_ FROM vhits WHERE rank <= 10 GROUP BY ALL) GROUP BY q_id) USING (q_id) WHERE doc_rank IS NULL OR doc_rank > 5",
    ),
    "e05_answer_overlap": (answer_overlap, f"WITH {S.VECTOR_HITS} SELECT q_id, round({_OVERLAP.format('h.text', 'c.question')}, 6) AS overlap FROM cases c JOIN vhits h USING (q_id) WHERE rank = 1"),
    "e06_citation_scores": (citation_scores, f"WITH {_JUDGED} SELECT q_id, round(citation, 6) AS citation FROM judged"),
    "e07_retrieval_scores": (retrieval_scores, f"WITH {S.VECTOR_HITS} SELECT c.q_id, round(coalesce({_GRADE}, 0), 6) AS retrieval FROM cases c LEFT JOIN vhits h ON h.q_id = c.q_id AND h.rank <= 20 WHERE c.gold_title IS NOT NULL GROUP BY c.q_id"),
    "e08_eval_run": (eval_run, f"WITH {_JUDGED} SELECT * FROM run"),
    "e09_recall_diagnosis": (recall_diagnosis, f"WITH {_DIAG} SELECT * FROM diag"),
    "e09_recall_summary": (
        recall_summary,
        f"WITH {_DIAG} SELECT count(*) AS case_count, "
        + ", ".join(f"round(avg(CASE WHEN status = '{s}' THEN 1e0 ELSE 0e0 END), 4) AS {s}_rate" for s in ("exact_top_k", "rerank_opportunity", "nearby_only", "recall_failure"))
        + ", CAST(median(gold_rank) AS DOUBLE) AS median_gold_rank FROM diag",
    ),
    "e10_seeded_cases": (
        seeded_cases,
        f"""WITH {S.CHUNKS}, p AS (SELECT chunk_id, document_title, md5('42:' || chunk_id) AS lot FROM chunks WHERE chunk_level = 'paragraph'),
        n AS (SELECT *, row_number() OVER (PARTITION BY document_title ORDER BY lot) AS nth FROM p), c AS (SELECT greatest(2, CAST(ceil(200e0 / count(DISTINCT document_title)) AS BIGINT)) AS cap FROM p)
        SELECT chunk_id, document_title FROM n, c WHERE nth <= cap ORDER BY lot LIMIT 200""",
    ),
    "e11_gold_repair": (
        gold_repair,
        f"""WITH {S.VECTOR_HITS}, o AS (SELECT c.q_id, c.gold_chunk, p.chunk_id, round({_OVERLAP.format("p.text", "c.question")}, 9) AS overlap FROM cases c JOIN chunks p ON p.doc_id || '' = regexp_extract(c.gold_chunk, '^(.*)-', 1) AND p.chunk_level = 'paragraph' WHERE c.gold_title IS NOT NULL),
        b AS (SELECT q_id, gold_chunk, arg_min(chunk_id, {{'l': -overlap, 'c': chunk_id}}) AS best, max(overlap) AS best_overlap, max(CASE WHEN chunk_id = gold_chunk THEN overlap END) AS own FROM o GROUP BY ALL)
        SELECT q_id, CASE WHEN best_overlap - own >= 0.05e0 THEN best ELSE gold_chunk END AS gold_chunk, best_overlap - own >= 0.05e0 AS repaired FROM b""",
    ),
    "e12_candidate_sweep": (
        candidate_sweep,
        f"""WITH {S.VECTOR_HITS}, r AS (SELECT c.q_id, min(CASE WHEN contains(lower(h.document_title), c.gold_doc) THEN h.rank END) AS doc_rank FROM cases c LEFT JOIN vhits h ON h.q_id = c.q_id AND h.rank <= 40 GROUP BY c.q_id)
        SELECT k AS candidates, round(avg(CASE WHEN doc_rank <= k THEN 1e0 ELSE 0e0 END), 4) AS hit_rate, round(avg(CASE WHEN doc_rank <= k THEN 1e0 / doc_rank ELSE 0e0 END), 4) AS mrr FROM r, (VALUES (5), (10), (20), (40)) t(k) GROUP BY k""",
    ),
    "e13_regression_gate": (
        regression_gate,
        f"""WITH {_RANKS}, m AS ({_METRICS}) SELECT * FROM (SELECT 'hit_at_5' AS metric, hit_at_5 AS value, 0.95e0 AS least, hit_at_5 >= 0.95 AS passed FROM m
        UNION ALL SELECT 'mrr', mrr, 0.85e0, mrr >= 0.85 FROM m UNION ALL SELECT 'page_hit_at_5', page_hit_at_5, 0.90e0, page_hit_at_5 >= 0.90 FROM m)""",
    ),
    "e14_model_scores": (
        model_scores,
        """SELECT event_type, round(cited * 60 + greatest(0e0, least(20e0, 20 * (1 - (latency - 2000) / 3000))) + CASE WHEN length_ < 500 THEN least(20e0, length_ / 25) ELSE greatest(0e0, 20 - (length_ - 500) / 100) END, 4) AS score
        FROM (SELECT event_type, avg(value * 100) AS latency, avg(CASE WHEN user_id % 2 = 0 THEN 1e0 ELSE 0e0 END) AS cited, avg(user_id * 3e0) AS length_ FROM events GROUP BY 1)""",
    ),
    "e15_thresholds": (
        thresholds,
        f"""WITH {_JUDGED} SELECT concat_ws(',', CASE WHEN retrieval_mean < 0.65 THEN 'retrieval' END, CASE WHEN answer_mean < 0.30 THEN 'answer' END, CASE WHEN citation_mean < 0.50 THEN 'citation' END) AS weak,
        CASE WHEN pass_rate >= 0.8 THEN 'excellent' WHEN pass_rate >= 0.7 THEN 'good' WHEN pass_rate >= 0.6 THEN 'acceptable' ELSE 'to improve' END AS grade FROM run""",
    ),
    "e16_answer_keywords": (answer_keywords, f"WITH {S.VECTOR_HITS} SELECT count(*) AS n, {_RATE.format('len(list_filter(keywords, lambda k: contains(lower(h.text), k))) > 0')} AS rate FROM cases c JOIN vhits h USING (q_id) WHERE rank = 1"),
    "e17_previews": (previews, f"WITH {S.VECTOR_HITS} SELECT q_id, chunk_id, document_title, round(1 - distance, 4) AS score, substring({S.squeeze('text')}, 1, 180) AS snippet FROM vhits WHERE rank = 1"),
}
