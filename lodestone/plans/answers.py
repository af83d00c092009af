"""Queries of answers, guards and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.engine import ANSWERS, Engine
from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.functions import vocabulary as V
from lodestone.operators import agent
from lodestone.operators import answers as A
from lodestone.plans import sql as S
from lodestone.plans.base import index, joined, questions, read, understood, vector_hits
from lodestone.sources import shared, tables


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def _answered(spark, sf_dir):
    asked = questions(spark, sf_dir).select("q_id", "question", Q.query_tokens(F.col("question")).alias("tokens"))
    return vector_hits(spark, sf_dir, 6).join(asked, "q_id")


def best_sentences(spark, sf_dir):
    return A.best_sentence(_answered(spark, sf_dir)).select("q_id", "rank", F.md5("sentence").alias("digest"))


def extractive_answers(spark, sf_dir):
    return A.extractive_answer(A.best_sentence(_answered(spark, sf_dir)))


def composed(spark, sf_dir):
    """Whole answers of the questions over their nearest vectors' chunks, without a model."""
    asked = questions(spark, sf_dir).select("q_id", "question", Q.query_tokens(F.col("question")).alias("tokens"))
    rows = A.composed(vector_hits(spark, sf_dir, 6), asked)
    return rows.select("q_id", F.md5("answer").alias("digest"), F.size("sources").alias("n_sources"), "used_model", "backend")


def modelled(spark, sf_dir):
    """Orders' answers by a model that gives a true and a false figure."""
    rows = read(spark, sf_dir, "orders")
    asked = rows.select(F.col("o_orderkey").alias("q_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(", what is it worth?")).alias("question"), F.array(F.lit("order")).alias("tokens"))
    text = F.concat(F.lit("营业收入 "), F.col("o_custkey").cast("string"))
    hits = rows.select(F.col("o_orderkey").alias("q_id"), F.lit(1).alias("rank"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.lit("Report").alias("document_title"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), text.alias("text"))
    found = A.composed(hits, asked, lambda prompts: prompts.str.extract(r"营业收入 (\d+)")[0].radd("It is ").add(" and not 77.5 [1] [7]."))
    return found.select("q_id", "answer", "used_model", "backend")


def asked_engine(spark, sf_dir):
    """The engine's answers to all questions."""
    rows = Engine(index(spark, sf_dir)).ask(understood(spark, sf_dir))
    return rows.select("q_id", F.md5("answer").alias("digest"), F.array_join("chunk_ids", " ").alias("chunk_ids"), "backend")


def cached_answers(spark, sf_dir):
    """Questions are asked twice: the second time all answers are cached."""
    engine, asked = Engine(index(spark, sf_dir)), questions(spark, sf_dir).where("q_id % 10 = 0")
    now = F.to_timestamp(F.lit("2024-01-01"))
    _, cache, log = engine.ask_cached(asked, spark.createDataFrame([], ANSWERS), now)
    rows, after, again = engine.ask_cached(asked, shared.kept(cache), now)
    counts = [x.agg(F.count("*").alias(name)) for x, name in ((log, "logged"), (again, "logged_again"), (after, "entries"))]
    out = rows.agg(F.count("*").alias("answers"), F.count_if("cached").alias("cached"))
    for more in counts:
        out = out.crossJoin(more)
    return out


def chatted(spark, sf_dir):
    """A turn of every tenth question's thread: intents, titles and memories that it leaves."""
    asked = questions(spark, sf_dir).where("q_id % 10 = 0").select("q_id", F.concat(F.lit("t"), F.col("q_id").cast("string")).alias("thread_id"), F.lit("u").alias("user_id"), "question")
    threads, memories = (spark.createDataFrame([], tables.TABLES[name]) for name in ("threads", "memories"))
    rows, after, kept = agent.chat(Engine(index(spark, sf_dir)), asked, threads, memories, F.to_timestamp(F.lit("2024-01-01")))
    counts = kept.agg((F.count("*") > 0).alias("remembers"))
    return after.join(rows.select("thread_id", "agent"), "thread_id").crossJoin(counts).select("thread_id", "title", "intent", "agent", "remembers")


def numbers(spark, sf_dir):
    n = T.numbers(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(n).alias("n"), joined(F.array_sort(n)).alias("numbers"))


#: An answer for each order line: its figures, of which the evidence has some.
_LINE_ANSWER = "concat('Order ', l_orderkey, ' sold ', cast(l_quantity as int), ' pieces at ', cast(l_extendedprice as bigint), ' [', l_linenumber, '].')"
_LINE_EVIDENCE = "concat('Quantity ', cast(l_quantity as int), ', order ', l_orderkey, ', line ', l_linenumber)"


def grounded_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", A.grounded(F.expr(_LINE_ANSWER), F.expr(_LINE_EVIDENCE)).alias("grounded"))


def guarded_answers(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", A.guarded(F.expr(_LINE_ANSWER), F.expr(_LINE_EVIDENCE)).alias("answer"))


def clean_citations(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    answer = F.expr("concat('Line [', l_linenumber, '] and [] up to [9]  through , see [', cast(l_quantity as int), '] .')")
    return rows.select("l_orderkey", "l_linenumber", T.clean_citations(answer, F.lit(4)).alias("answer"))


_ROW_TEXT = "concat('单位：万元 Segment results 2023 2022 2021 Total revenues ', cast(l_extendedprice as bigint), ' ', cast(l_quantity as int), ' 营业收入 ', cast(l_quantity as int), ' 12% 净资产 ', l_orderkey)"


def financial_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_ROW_TEXT).alias("text"))
    metrics = A.labelled_numbers(F.col("text"), V.METRIC_LABELS)
    return rows.select("l_orderkey", "l_linenumber", A.rendered_metrics(metrics, A.unit_of(F.col("text"))).alias("metrics"))


def direct_facts(spark, sf_dir):
    """Each order's text is asked for the total revenue of 2022."""
    text = F.expr("concat('Segment results 2023 2022 2021 Total revenues ', cast(o_totalprice as bigint), ' ', o_custkey)")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"), F.lit("What was the total revenue in 2022?").alias("question"), F.lit(1).alias("rank"), text.alias("text"))
    return A.direct_facts(rows)


def prompts(spark, sf_dir):
    rows = _answered(spark, sf_dir).groupBy("q_id", "question").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("document_title").alias("title"), "text"))), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))).alias("sources"))
    return rows.select("q_id", F.md5(A.prompt(F.col("question"), F.col("sources"), F.lit(""))).alias("digest"))


def citations(spark, sf_dir):
    return vector_hits(spark, sf_dir, 6).select("q_id", "rank", T.citation(F.col("document_title"), F.col("page_start"), F.col("page_end")).alias("citation"))


def _fact_answers(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    answer = F.expr("concat('Tesla revenue was $', cast(l_extendedprice as bigint), ' million in 2023 [', l_linenumber, ']')")
    return rows.select(F.col("l_orderkey").alias("q_id"), F.lit("What was the revenue of Tesla?").alias("question"), answer.alias("answer"), F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("sources"), F.array(F.lit("Annual report")).alias("titles"), F.array(F.col("l_suppkey").cast("string")).alias("chunk_ids"))


def fact_candidates(spark, sf_dir):
    return A.fact_candidates(_fact_answers(spark, sf_dir))


def merged_facts(spark, sf_dir):
    new = A.fact_candidates(_fact_answers(spark, sf_dir))
    old = new.where("q_id % 2 = 0").withColumn("confidence", F.lit(0.9))
    rows = A.merged_facts(old, new)
    return rows.groupBy("pending_review", "confidence").agg(F.count("*").alias("n"))


def summaries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.first_sentences(F.col("text"), 2, 320, 280)).alias("digest"))


def contexts(spark, sf_dir):
    """The first hits of a question as an agent reads them: up to five, 600 characters of each."""
    shown = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.citation(F.col("document_title"), F.col("page_start"), F.col("page_end")), F.lit("\n"), F.substring(T.squeeze(F.col("text")), 1, 600))
    rows = vector_hits(spark, sf_dir, 6).where("rank <= 5").groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", shown.alias("shown")))).alias("s"))
    return rows.select("q_id", F.md5(F.array_join("s.shown", "\n\n")).alias("digest"))


def formatted_answers(spark, sf_dir):
    """An answer with its list of sources."""
    answers = A.extractive_answer(A.best_sentence(_answered(spark, sf_dir)))
    cited = citations(spark, sf_dir).where("rank <= 3").groupBy("q_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "citation"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["citation"])), "\n").alias("sources"))
    return answers.join(cited, "q_id").select("q_id", F.md5(F.concat("answer", F.lit("\n\n"), "sources")).alias("digest"))


_SENTENCES = f"""texts_ AS (SELECT v.q_id, v.chunk_id, v.rank, v.text, v.document_title, v.page_start, v.page_end, b.text AS question, {S.query_tokens("b.text")} AS qtoks FROM vhits v JOIN benchmark b ON b.item_id = v.q_id WHERE rank <= 6),
sent AS (SELECT q_id, chunk_id, rank, qtoks, unnest(s) AS sentence, unnest(range(len(s))) AS place FROM (SELECT *, ({S.sentences("text")})[1:8] AS s FROM texts_)),
own AS (SELECT *, {S.tokens("sentence")} AS stoks FROM sent),
sc AS (SELECT q_id, rank, sentence, place, round(list_sum(list_concat([0e0], list_transform(list_distinct(stoks), lambda t: least(len(list_filter(stoks, lambda y: y = t)), len(list_filter(qtoks, lambda z: z = t)))))) + least(1e0, length(sentence) / 180e0), 9) AS score FROM own),
best AS (SELECT q_id, rank, arg_max(sentence, {{'s': score, 'p': -place}}) AS sentence FROM sc GROUP BY q_id, rank)"""
_H = f"{S.VECTOR_HITS},\n{_SENTENCES}"
_CITE = "document_title || ' p.' || CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END"
_ANSWER = "'基于检索到的资料，' || chr(10) || string_agg(rank || '. ' || CASE WHEN regexp_matches(sentence, '[。.!?！？]$') THEN sentence ELSE sentence || '。' END || ' [' || rank || ']', chr(10) ORDER BY rank)"



def _cleaned(x: str, n: int) -> str:
    """Citations beyond n (one digit) go."""
    x = S.sub(S.sub(x, r"\[\s*\]", "''"), rf"\[0*(?:[{n + 1}-9]|[1-9]\d+)\]|\[0+\]", "''")
    x = S.sub(x, r"(?i)(?:至|到|through)\s*([,.;，。；\s]|$)", r"'\1'")
    x = S.sub(S.sub(x, r"\s+([,.;，。；])", r"'\1'"), r"[ \t]{2,}", "' '")
    return S.strip(S.sub(x, r"\n{3,}", "chr(10) || chr(10)"))


#: The six hits of the lexical retrieval with heuristic reranking.
_SIX = f"""{S.LEXICAL}, para AS (SELECT * FROM hits WHERE chunk_level <> 'chapter'), top_ AS (SELECT * FROM ({S.ranked("para", "score DESC", "place")}) WHERE place <= 30),
re AS (SELECT q_id, chunk_id, document_title, section_title, text, page_start, page_end, round(score + {S.RERANK_BONUS}, 9) AS score FROM top_),
vhits AS (SELECT * FROM ({S.ranked("re", "score DESC")}) WHERE rank <= 6)"""

QUERIES = {
    "a12_composed": (
        composed,
        f"""WITH {_H}, a AS (SELECT q_id, {_ANSWER} AS answer FROM best WHERE rank <= 3 GROUP BY q_id), n AS (SELECT q_id, count(*) AS n FROM vhits WHERE rank <= 6 GROUP BY q_id)
        SELECT b.item_id AS q_id, md5(coalesce(CASE n {" ".join(f"WHEN {k} THEN {_cleaned('answer', k)}" for k in range(1, 7))} END, '基于检索到的资料，' || chr(10) || '当前检索结果不足以直接回答，需要扩大检索范围。')) AS digest, CAST(n AS INTEGER) AS n_sources, FALSE AS used_model, 'extractive' AS backend
        FROM benchmark b LEFT JOIN a ON a.q_id = b.item_id LEFT JOIN n ON n.q_id = b.item_id""",
    ),
    "a12_modelled": (
        modelled,
        """SELECT o_orderkey AS q_id, 'It is ' || o_custkey || ' and not' || CASE WHEN o_custkey = 1 THEN ' [1].' ELSE '.' END || chr(10) || chr(10) || '注：已移除未在证据中出现的数值。' || chr(10) || chr(10) || '指标摘录（来自证据）：' || chr(10) || '- 营业收入: ' || o_custkey AS answer, TRUE AS used_model, 'model' AS backend FROM orders""",
    ),
    "p01_ask": (
        asked_engine,
        f"""WITH {_SIX}, {_SENTENCES}, a AS (SELECT q_id, {_ANSWER} AS answer FROM best WHERE rank <= 3 GROUP BY q_id), n AS (SELECT q_id, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids FROM vhits GROUP BY q_id)
        SELECT q_id, md5({_cleaned("answer", 6)}) AS digest, chunk_ids, 'extractive' AS backend FROM a JOIN n USING (q_id)""",
    ),
    "a12_cached_answers": (
        cached_answers,
        "SELECT count(*) AS answers, count(*) AS cached, count(DISTINCT lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS logged, CAST(0 AS BIGINT) AS logged_again, count(DISTINCT lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS entries FROM benchmark WHERE item_id % 10 = 0",
    ),
    "p07_chat": (
        chatted,
        f"""SELECT 't' || item_id AS thread_id, substring(text, 1, 80) AS title, i AS intent, CASE i WHEN 'financial' THEN 'financial_agent' ELSE 'react_planner' END AS agent, TRUE AS remembers FROM
        (SELECT *, CASE WHEN c IN ('financial', 'market') THEN c WHEN c = 'technology' THEN 'technical' ELSE 'general' END AS i FROM (SELECT *, {S.category("text")} AS c FROM benchmark WHERE item_id % 10 = 0))""",
    ),
    "a01_prompts": (
        prompts,
        f"""WITH {S.VECTOR_HITS} SELECT q_id, md5('Answer only from the sources and cite them as [n].' || chr(10) || chr(10) || 'Question: ' || any_value(b.text) || chr(10) || chr(10)
        || string_agg('[' || place || '] ' || document_title || chr(10) || substring({S.squeeze("v.text")}, 1, 700), chr(10) || chr(10) ORDER BY rank)) AS digest
        FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS place FROM vhits WHERE rank <= 6) v JOIN benchmark b ON b.item_id = v.q_id GROUP BY q_id""",
    ),
    "a02_best_sentences": (best_sentences, f"WITH {_H} SELECT q_id, rank, md5(sentence) AS digest FROM best"),
    "a03_extractive_answers": (extractive_answers, f"WITH {_H} SELECT q_id, {_ANSWER} AS answer FROM best WHERE rank <= 3 GROUP BY q_id"),
    "a04_numbers": (
        numbers,
        f"""SELECT page_id, CAST(len(n) AS INTEGER) AS n, array_to_string(list_sort(n), ' ') AS numbers FROM
        (SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '{S.NUMBER}'), lambda x: replace(x, ',', ''))) AS n FROM pages)""",
    ),
    "a05_grounded": (grounded_numbers, "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) IN (CAST(l_quantity AS INTEGER), l_orderkey, l_linenumber) AS grounded FROM (SELECT l_orderkey, l_linenumber, trunc(l_quantity) AS l_quantity, trunc(l_extendedprice) AS l_extendedprice FROM lineitem)"),
    "a06_guarded_answers": (
        guarded_answers,
        """SELECT l_orderkey, l_linenumber, CASE WHEN p IN (q, l_orderkey, l_linenumber) THEN 'Order ' || l_orderkey || ' sold ' || q || ' pieces at ' || p || ' [' || l_linenumber || '].'
        ELSE 'Order ' || l_orderkey || ' sold ' || q || ' pieces at [' || l_linenumber || '].' || chr(10) || chr(10) || '注：已移除未在证据中出现的数值。' END AS answer
        FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS q, CAST(trunc(l_extendedprice) AS BIGINT) AS p FROM lineitem)""",
    ),
    "a07_clean_citations": (
        clean_citations,
        """SELECT l_orderkey, l_linenumber, 'Line' || CASE WHEN l_linenumber <= 4 THEN ' [' || l_linenumber || ']' ELSE '' END || ' and up to, see' || CASE WHEN q BETWEEN 1 AND 4 THEN ' [' || q || '].' ELSE '.' END AS answer
        FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem)""",
    ),
    "a08_a09_metrics": (
        financial_metrics,
        """SELECT l_orderkey, l_linenumber, '- 营业收入: ' || q || ' 万元 (YoY 12%)' || chr(10) || '- 净资产: ' || l_orderkey || ' 万元' AS metrics
        FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem)""",
    ),
    "a10_direct_facts": (
        direct_facts,
        """SELECT q_id, 'total revenues' AS label, v AS value, 1 AS rank, 'The total revenues figure for 2022 was $' || v || ' million [1] (matched row: Total revenues).' AS answer FROM
        (SELECT o_orderkey AS q_id, CAST(coalesce(v[2], v[1]) AS VARCHAR) AS v FROM
        (SELECT o_orderkey, list_filter([CAST(trunc(o_totalprice) AS BIGINT), o_custkey], lambda x: x NOT BETWEEN 2000 AND 2099) AS v FROM orders))""",
    ),
    "a13_citations": (citations, f"WITH {S.VECTOR_HITS} SELECT q_id, rank, {_CITE} AS citation FROM vhits WHERE rank <= 6"),
    "a14_fact_candidates": (
        fact_candidates,
        """SELECT l_orderkey AS q_id, 'Tesla' AS company, 'revenue' AS metric, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR) AS value, 'USD million' AS unit, CASE WHEN trunc(l_extendedprice) BETWEEN 2000 AND 2099 THEN CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR) ELSE '2023' END AS period, 'part ' || l_partkey AS source_citation, CAST(l_suppkey AS VARCHAR) AS source_chunk_id, 0.85e0 AS confidence
        FROM lineitem WHERE l_linenumber = 1""",
    ),
    "a15_merged_facts": (
        merged_facts,
        """WITH f AS (SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) AS v, l_partkey AS p FROM lineitem WHERE l_linenumber = 1),
        g AS (SELECT v, p, bool_or(l_orderkey % 2 = 0) AS old FROM f GROUP BY v, p)
        SELECT NOT old AS pending_review, CASE WHEN old THEN 0.9e0 ELSE 0.85e0 END AS confidence, count(*) AS n FROM g GROUP BY 1, 2""",
    ),
    "a16_formatted_answers": (
        formatted_answers,
        f"""WITH {_H}, a AS (SELECT q_id, {_ANSWER} AS answer FROM best WHERE rank <= 3 GROUP BY q_id),
        c AS (SELECT q_id, string_agg('[' || rank || '] ' || {_CITE}, chr(10) ORDER BY rank) AS sources FROM vhits WHERE rank <= 3 GROUP BY q_id)
        SELECT q_id, md5(answer || chr(10) || chr(10) || sources) AS digest FROM a JOIN c USING (q_id)""",
    ),
    "a17_summaries": (
        summaries,
        f"""SELECT doc_id, md5(CASE WHEN len(s) = 0 THEN substring(t, 1, 280) ELSE substring(array_to_string(s[1:2], ' '), 1, 320) END) AS digest
        FROM (SELECT doc_id, t, {S.sentences("t")} AS s FROM (SELECT doc_id, {S.squeeze("text")} AS t FROM documents))""",
    ),
    "a18_contexts": (
        contexts,
        f"WITH {S.VECTOR_HITS} SELECT q_id, md5(string_agg('[' || rank || '] ' || {_CITE} || chr(10) || substring({S.squeeze('text')}, 1, 600), chr(10) || chr(10) ORDER BY rank)) AS digest FROM vhits WHERE rank <= 5 GROUP BY q_id",
    ),
}
