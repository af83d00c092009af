"""Queries of scoring and retrieval; all questions of ``benchmark`` are asked at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.functions import vocabulary as V
from lodestone.operators import retrieval as R
from lodestone.operators.index import build_index, tokenised, whole
from lodestone.plans import sql as S
from lodestone.plans.base import chunks, index, indexed_chunks, joined, questions, read, understood, vector_hits, vector_ranks
from lodestone.sources import shared


def _asked(spark, sf_dir):
    return understood(spark, sf_dir)


def _hits(spark, sf_dir, most):
    """Hits, complete for the first ``most`` of a question."""
    return R.lexical(index(spark, sf_dir), _asked(spark, sf_dir), most)


def idf(spark, sf_dir):
    return index(spark, sf_dir).idf.select("token", "df", F.round("idf", 9).alias("idf"))


def coverage(spark, sf_dir):
    rows = R.coverage(index(spark, sf_dir), _asked(spark, sf_dir))
    return rows.select("q_id", "chunk_id", F.round("coverage", 6).alias("coverage"))


def lexical_top(spark, sf_dir):
    rows = R.ranked(_hits(spark, sf_dir, 20), F.desc("score"), most=20)
    return rows.select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def own_bonus(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("category", Q.category(F.col("text")))
    return rows.select("chunk_id", F.round(R.own_bonus(F.col("category")), 6).alias("bonus"))


def section_bonus(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", Q.category(F.col("text")).alias("category"), F.lower("text").alias("section"))
    return rows.select("doc_id", F.round(Q.section_bonus(F.col("section"), F.col("category")), 6).alias("bonus"))


def metric_bonus(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(Q.metric_bonus(F.col("text")), 6).alias("bonus"))


def matched_terms(spark, sf_dir):
    built, asked = index(spark, sf_dir), _asked(spark, sf_dir)
    rows = R.with_terms(R.ranked(R.lexical(built, asked, 5), F.desc("score"), most=5), built.chunks, built, asked)
    return rows.select("q_id", "chunk_id", F.size("terms").alias("n_terms"), joined(F.array_sort("terms")).alias("terms"))


def category_hits(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", Q.category_hits(F.lower("text"), Q.category(F.col("text"))).alias("hits"))


def target_isolation(spark, sf_dir):
    """Questions target the sources that have their number here."""
    hits = R.ranked(_hits(spark, sf_dir, 50), F.desc("score"), most=50, name="place").withColumn("targets", F.array(F.concat(F.lit("src"), (F.col("q_id") % 20).cast("string"))))
    return R.isolated(hits, 2).groupBy("q_id").agg(F.count("*").alias("n"))


def chapters_and_paragraphs(spark, sf_dir):
    """The first three hits of each level, as they seed the two parts of a top."""
    rows = _hits(spark, sf_dir, 3).withColumn("level", F.col("chunk_level"))
    order = Window.partitionBy("q_id", "level").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("q_id", "level", "rank", "chunk_id", F.round("score", 6).alias("score"))


def context_expansion(spark, sf_dir):
    hits = R.ranked(_hits(spark, sf_dir, 20).where("chunk_level = 'paragraph'"), F.desc("score"), most=20, name="place").drop("place", "category")
    found = R.context_expansion(hits, indexed_chunks(spark, sf_dir), _asked(spark, sf_dir), replace(R.RetrievalConfig(), top_k=20))
    return found.select("q_id", "chunk_id", F.round("score", 6).alias("score"), "seed")


def category_fallback(spark, sf_dir):
    """Questions target the sources that have their number here."""
    asked = _asked(spark, sf_dir).withColumn("targets", F.array(F.concat(F.lit("src"), (F.col("q_id") % 20).cast("string"), F.lit(" "))))
    near = vector_ranks(spark, sf_dir, 30, indexed_chunks(spark, sf_dir).select("chunk_id"))
    hits = R.ranked(near.withColumn("score", 1 - F.col("distance")).drop("rank"), F.desc("score"), most=30, name="place")
    found = R.category_fallback(hits.select("q_id", "chunk_id", "score"), index(spark, sf_dir), asked, replace(R.RetrievalConfig(), top_k=20))
    return found.select("q_id", "chunk_id", F.round("score", 6).alias("score"))


def vector_knn(spark, sf_dir):
    return vector_ranks(spark, sf_dir, 80).select("q_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


def vector_only(spark, sf_dir):
    rows = vector_hits(spark, sf_dir, 10)
    return rows.select("q_id", "rank", "chunk_id", "document_title", F.round(1 - F.col("distance"), 6).alias("similarity"))


def fusion(spark, sf_dir):
    hits = _hits(spark, sf_dir, 200).where("chunk_level = 'paragraph'").select("q_id", "chunk_id", "score")
    vectors = vector_ranks(spark, sf_dir, 80).join(indexed_chunks(spark, sf_dir).select("chunk_id"), "chunk_id", "left_semi")
    rows = R.fused(R.ranked(hits, F.desc("score"), most=200).select("q_id", "chunk_id", "score"), vectors, R.RetrievalConfig())
    return R.ranked(rows, F.col("tier"), F.desc("score"), most=10).select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _financial(section):
    """Sections that hold "The" are the financial ones here."""
    return F.when(F.contains(section, F.lit("The")), F.lit("财务报告")).otherwise(section)


def financial_focus(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("section_title", _financial(F.col("section_title")))
    found = R.financial_focus(build_index(tokenised(rows), lambda table, _: shared.kept(table)), _asked(spark, sf_dir), R.RetrievalConfig())
    return R.ranked(found, F.desc("score")).select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def focused_first(spark, sf_dir):
    hits = vector_hits(spark, sf_dir, 30).withColumn("score", 1 - F.col("distance")).withColumn("section_title", F.when(F.col("rank") % 3 == 0, F.lit("财务报告")).otherwise(F.col("section_title")))
    rows = R.focused_first(hits.drop("rank"), 6)
    return R.ranked(rows, F.col("tier"), F.desc("focus_score"), most=10).select("q_id", "rank", "chunk_id", "tier")


def rerank_bonus(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("category", Q.category(F.col("text")))
    return rows.select("chunk_id", F.round(R.rerank_bonus(), 6).alias("bonus"))


def blended(spark, sf_dir):
    """The share of the question's words that a hit's text has stands for a model's score."""
    hits = vector_hits(spark, sf_dir, 30).withColumn("score", F.round(1 - F.col("distance"), 9)).join(questions(spark, sf_dir), "q_id")
    model = F.round(F.size(F.array_intersect(T.words(F.col("question")), T.words(F.col("text")))) / F.size(F.array_distinct(T.words(F.col("question")))), 9)
    rows = R.blended(hits.withColumn("model_score", model))
    return rows.select("q_id", "chunk_id", F.round("blend", 6).alias("blend"))


def candidate_text(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", F.md5(R.candidate_text()).alias("digest"))


def retrieve(spark, sf_dir):
    rows = R.retrieve(index(spark, sf_dir), _asked(spark, sf_dir))
    return rows.select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "document_title")


def _targeted(spark, sf_dir):
    """Questions target the sources that have their number here."""
    return _asked(spark, sf_dir).withColumn("targets", F.array(F.concat(F.lit("src"), (F.col("q_id") % 20).cast("string"))))


def targeted(spark, sf_dir):
    rows = R.retrieve(index(spark, sf_dir), _targeted(spark, sf_dir))
    return rows.select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "document_title")


def targeted_lexical(spark, sf_dir):
    rows = R.lexical(index(spark, sf_dir), _targeted(spark, sf_dir), 20)
    return R.ranked(rows, F.desc("score"), most=20).select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def variants(spark, sf_dir):
    """The first hits of each strategy."""
    built, asked, vectors = index(spark, sf_dir), _asked(spark, sf_dir), vector_ranks(spark, sf_dir, 80)
    parts = []
    for name, config in R.STRATEGIES.items():
        if name == "vector":
            rows = vector_hits(spark, sf_dir, 6).select("q_id", "rank", "chunk_id")
        else:
            known = vectors.join(built.chunks.select("chunk_id"), "chunk_id", "left_semi") if config.vector else None
            rows = R.retrieve(built, asked, config, known).select("q_id", "rank", "chunk_id")
        parts.append(rows.withColumn("strategy", F.lit(name)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _shared_words(asked, texts):
    """A stand-in for a model of pairs: the share of a question's words that a text has."""
    return asked.combine(texts, lambda a, b: round(len(set(a.split()) & set(b.split())) / len(set(a.split())), 9))


def reranked(spark, sf_dir):
    """Scores of pairs by a model; those of every fourth vector's chunk are known already."""
    hits = vector_hits(spark, sf_dir, 30).join(questions(spark, sf_dir), "q_id")
    known = hits.where(F.regexp_extract("chunk_id", r"^(\d+)-", 1).cast("long") % 4 == 0)
    cache = known.select(Q.query_hash(F.col("question")).alias("query_hash"), "chunk_id", F.lit("words").alias("model"), F.lit(0.5).alias("score")).distinct()
    rows = R.Reranker("words", _shared_words, cache).scored(hits)
    return rows.select("q_id", "chunk_id", "cached", F.round("model_score", 6).alias("model_score"))


def compared_companies(spark, sf_dir):
    rows = vector_hits(spark, sf_dir, 10)
    sides = [R.for_company(rows, name).groupBy("q_id").agg(F.count("*").alias("n")).withColumn("company", F.lit(name)) for name in ("src1", "src2")]
    return sides[0].unionByName(sides[1])


def warmed(spark, sf_dir):
    """What a warm index holds."""
    built = index(spark, sf_dir)
    named = built.chunks.where(whole().rlike("[A-Za-z0-9]|[一-鿿]")).agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return built.idf.agg(F.sum("df").alias("n_postings"), F.count("*").alias("n_tokens")).crossJoin(named).select("n_postings", "n_chunks", "n_tokens")


_LOWER = "lower(coalesce(section_title, ''))"
_CASES = f"WITH {S.CHUNKS}, rows_ AS (SELECT *, {S.category('text')} AS category FROM chunks)"

#: Scores with sections that hold "The" as financial ones, by focus tokens.
_SECTION_SQL = "array_to_string(regexp_extract_all(string_split(text, chr(10))[1], '\\S+')[1:4], ' ')"
_FOCUS = S.LEXICAL.replace(f"{_SECTION_SQL} AS section_title", f"CASE WHEN contains({_SECTION_SQL}, 'The') THEN '财务报告' ELSE {_SECTION_SQL} END AS section_title").replace(
    f"{S.query_tokens('text')} AS qtoks", f"{S.without_noise('list_concat(' + S.tokens(S.expanded('text')) + ', ' + S.tokens(S.q(' '.join(V.METRIC_TERMS))) + ')')} AS qtoks"
)
#: Scores where a question targets the sources that have its number.
_TARGETED = S.LEXICAL.replace(f"{S.targets('text')} AS targets", "['src' || (item_id % 20)] AS targets")
_MATCH = "contains(lower(document_title), 'src' || (q_id % 20))"
_ISOLATED = f"iso AS (SELECT a.q_id FROM asked a JOIN chunks c ON contains(lower(c.document_title), a.targets[1]) GROUP BY a.q_id HAVING count(*) >= 12), kept AS (SELECT * FROM hits WHERE q_id NOT IN (SELECT q_id FROM iso) OR {_MATCH})"

QUERIES = {
    "r01_idf": (idf, f"WITH {S.INDEX} SELECT token, df, round(idf, 9) AS idf FROM idf"),
    "r02_coverage": (coverage, f"WITH {S.LEXICAL} SELECT q_id, chunk_id, round(overlap / greatest(0.01e0, whole), 6) AS coverage FROM matched JOIN whole USING (q_id)"),
    "r02_lexical_top": (lexical_top, f"WITH {S.LEXICAL}, r AS ({S.ranked('hits', 'score DESC')}) SELECT q_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 20"),
    "r03_own_bonus": (own_bonus, f"{_CASES} SELECT chunk_id, round({S.OWN_BONUS}, 6) AS bonus FROM rows_"),
    "r04_section_bonus": (section_bonus, f"SELECT doc_id, round({S.section_bonus('lower(text)', 'category')}, 6) AS bonus FROM (SELECT *, {S.category('text')} AS category FROM documents)"),
    "r05_metric_bonus": (metric_bonus, f"SELECT doc_id, round(least(0.24e0, 0.03e0 * {S.count_of('text', V.METRIC_TERMS)}), 6) AS bonus FROM documents"),
    "r06_matched_terms": (matched_terms, f"WITH {S.LEXICAL}, r AS ({S.ranked('hits', 'score DESC')}) SELECT q_id, chunk_id, CAST(len(terms[1:10]) AS INTEGER) AS n_terms, array_to_string(list_sort(terms[1:10]), ' ') AS terms FROM r WHERE rank <= 5"),
    "r07_category_hits": (category_hits, f"SELECT doc_id, {S.category_hits('lower(text)', S.category('text'))} AS hits FROM documents"),
    "r08_target_isolation": (
        target_isolation,
        f"""WITH {S.LEXICAL}, r AS ({S.ranked("hits", "score DESC")}), m AS (SELECT q_id, contains(lower(document_title), 'src' || (q_id % 20)) AS match FROM r WHERE rank <= 50),
        n AS (SELECT q_id, count(*) FILTER (match) AS k, count(*) AS a FROM m GROUP BY q_id) SELECT q_id, CASE WHEN k >= 4 THEN k ELSE a END AS n FROM n""",
    ),
    "r09_levels": (
        chapters_and_paragraphs,
        f"""WITH {S.LEXICAL} SELECT q_id, chunk_level AS level, rank, chunk_id, round(score, 6) AS score FROM
        (SELECT *, CAST(row_number() OVER (PARTITION BY q_id, chunk_level ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM hits) WHERE rank <= 3""",
    ),
    "r10_category_fallback": (
        category_fallback,
        f"""WITH {S.VECTOR_HITS}, f AS (SELECT q_id, chunk_id, 1 - distance AS score, row_number() OVER (PARTITION BY q_id ORDER BY 1 - distance DESC, chunk_id) AS place FROM vhits),
        floor_ AS (SELECT q_id, min(score) AS floor_ FROM f WHERE place <= 20 GROUP BY q_id),
        c AS (SELECT b.item_id AS q_id, c.*, {S.category_hits(S.q("") + " || lower(concat_ws(' ', c.document_title, nullif(c.section_title, ''), c.text))", S.category("b.text"))} AS hits
          FROM benchmark b JOIN chunks c ON c.chunk_level <> 'chapter' AND contains(lower(c.document_title), 'src' || (b.item_id % 20) || ' ')),
        n AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY hits DESC, page_start DESC, chunk_id) - 1 AS nth FROM c WHERE hits > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.q_id = c.q_id AND f.chunk_id = c.chunk_id AND f.place <= 30))
        SELECT q_id, chunk_id, round(coalesce(floor_, 0.3e0) - 0.2e0 - 0.002e0 * nth + least(0.2e0, 0.04e0 * hits), 6) AS score FROM n LEFT JOIN floor_ USING (q_id) WHERE nth < 40""",
    ),
    "r11_context_expansion": (
        context_expansion,
        f"""WITH {S.LEXICAL}, para AS (SELECT * FROM hits WHERE chunk_level = 'paragraph'), top_ AS (SELECT * FROM ({S.ranked("para", "score DESC", "place")}) WHERE place <= 20),
        seeds AS (SELECT q_id, category, place AS seed_no, chunk_id AS seed, score AS seed_score, parent_chunk_id AS parent, document_title AS title, page_start AS first_, page_end AS last_ FROM top_ WHERE place <= 12),
        near AS (SELECT s.*, 0 AS way, c.chunk_id, c.document_title, c.section_title, c.text FROM seeds s JOIN chunks c ON c.chunk_level <> 'chapter' AND c.parent_chunk_id = s.parent
          UNION ALL SELECT s.*, 1, c.chunk_id, c.document_title, c.section_title, c.text FROM seeds s JOIN chunks c ON c.chunk_level <> 'chapter' AND c.document_title = s.title AND c.page_start = s.first_ AND c.page_end = s.last_),
        h AS (SELECT *, {S.category_hits("lower(concat_ws(' ', document_title, nullif(section_title, ''), text))", "category")} AS hits_ FROM near),
        n AS (SELECT *, row_number() OVER (PARTITION BY q_id, seed, way ORDER BY hits_ DESC, chunk_id) AS nth FROM h),
        x AS (SELECT *, row_number() OVER (PARTITION BY q_id, chunk_id ORDER BY seed_no, way) AS first_one FROM n WHERE nth <= 4 AND NOT EXISTS (SELECT 1 FROM top_ t WHERE t.q_id = n.q_id AND t.chunk_id = n.chunk_id))
        SELECT q_id, chunk_id, round(round(seed_score - 0.12e0 - 0.01e0 * (seed_no - 1) + least(0.18e0, 0.04e0 * hits_), 9), 6) AS score, seed FROM x WHERE first_one = 1""",
    ),
    "r12_vector_knn": (vector_knn, f"WITH {S.VECTOR_HITS} SELECT q_id, rank, chunk_id, round(distance, 6) AS distance FROM ({S.ranked('near', 'distance')}) WHERE rank <= 80"),
    "r13_vector_only": (vector_only, f"WITH {S.VECTOR_HITS} SELECT q_id, rank, chunk_id, document_title, round(1 - distance, 6) AS similarity FROM vhits WHERE rank <= 10"),
    "r14_fusion": (
        fusion,
        f"""WITH {S.LEXICAL}, {S.VECTOR_HITS.replace(S.CHUNKS + ",", "", 1)}, para AS (SELECT q_id, chunk_id, score FROM hits WHERE chunk_level = 'paragraph'),
        lex AS (SELECT q_id, chunk_id, rank AS l FROM ({S.ranked("para", "score DESC")}) WHERE rank <= 200), v AS (SELECT q_id, chunk_id, rank AS r FROM vhits WHERE rank <= 80),
        f AS (SELECT q_id, chunk_id, round(coalesce(1e0 / (60 + l), 0) + coalesce(1e0 / (60 + r), 0), 9) AS score FROM lex FULL JOIN v USING (q_id, chunk_id))
        SELECT q_id, rank, chunk_id, round(score, 6) AS score FROM ({S.ranked("f", "score DESC")}) WHERE rank <= 10""",
    ),
    "r15_financial_focus": (
        financial_focus,
        f"""WITH {_FOCUS}, f AS (SELECT * FROM hits WHERE category = 'financial' AND chunk_level <> 'chapter' AND {S.any_of("coalesce(section_title, '')", V.FINANCIAL_SECTIONS)})
        SELECT q_id, rank, chunk_id, round(score, 6) AS score FROM ({S.ranked("f", "score DESC")}) WHERE rank <= 80""",
    ),
    "r16_focused_first": (
        focused_first,
        f"""WITH {S.VECTOR_HITS}, h AS (SELECT *, 1 - distance AS score, CASE WHEN rank % 3 = 0 THEN 0 ELSE 1 END AS tier FROM vhits WHERE rank <= 30),
        n AS (SELECT q_id, chunk_id, CASE WHEN count(*) FILTER (tier = 0) OVER (PARTITION BY q_id) >= 3 THEN tier ELSE 1 END AS tier, document_title, text, score FROM h),
        o AS (SELECT q_id, chunk_id, tier, score + CASE WHEN tier = 0 THEN least(0.24e0, 0.03e0 * {S.count_of("document_title || ' 财务报告 ' || text", V.METRIC_TERMS)}) ELSE 0 END AS focus_score FROM n)
        SELECT q_id, rank, chunk_id, tier FROM ({S.ranked("o", "tier, focus_score DESC")}) WHERE rank <= 10""",
    ),
    "r17_rerank_bonus": (rerank_bonus, f"{_CASES} SELECT chunk_id, round({S.RERANK_BONUS}, 6) AS bonus FROM rows_"),
    "r18_blended": (
        blended,
        f"""WITH {S.VECTOR_HITS}, h AS (SELECT v.q_id, v.chunk_id, round(1 - distance, 9) AS score,
          round(len(list_intersect(list_distinct(regexp_extract_all(b.text, '\\S+')), list_distinct(regexp_extract_all(v.text, '\\S+')))) / CAST(len(list_distinct(regexp_extract_all(b.text, '\\S+'))) AS DOUBLE), 9) AS model_score
          FROM vhits v JOIN benchmark b ON b.item_id = v.q_id WHERE rank <= 30),
        w AS (SELECT *, min(score) OVER p AS s0, max(score) OVER p AS s1, min(model_score) OVER p AS m0, max(model_score) OVER p AS m1 FROM h WINDOW p AS (PARTITION BY q_id))
        SELECT q_id, chunk_id, round(round(0.5e0 * CASE WHEN m1 <= m0 THEN 0.5e0 ELSE (model_score - m0) / (m1 - m0) END + 0.5e0 * CASE WHEN s1 <= s0 THEN 0.5e0 ELSE (score - s0) / (s1 - s0) END, 9), 6) AS blend FROM w""",
    ),
    "r19_candidate_text": (candidate_text, f"WITH {S.CHUNKS} SELECT chunk_id, md5(substring(document_title || chr(10) || coalesce(section_title, '') || chr(10) || {S.squeeze('text')}, 1, 1800)) AS digest FROM chunks"),
    "r20_retrieve": (
        retrieve,
        f"""WITH {S.LEXICAL}, para AS (SELECT * FROM hits WHERE chunk_level <> 'chapter'), top_ AS (SELECT * FROM ({S.ranked("para", "score DESC", "place")}) WHERE place <= 30),
        re AS (SELECT q_id, chunk_id, document_title, round(score + {S.RERANK_BONUS}, 9) AS score FROM top_)
        SELECT q_id, rank, chunk_id, round(score, 6) AS score, document_title FROM ({S.ranked("re", "score DESC")}) WHERE rank <= 6""",
    ),
    "r20_targeted": (
        targeted,
        f"""WITH {_TARGETED}, {_ISOLATED}, para AS (SELECT * FROM kept WHERE chunk_level <> 'chapter'), top_ AS (SELECT * FROM ({S.ranked("para", "score DESC", "place")}) WHERE place <= 30),
        re AS (SELECT q_id, chunk_id, document_title, round(score + {S.RERANK_BONUS}, 9) AS score FROM top_),
        six AS (SELECT * FROM ({S.ranked("re", "score DESC")}) WHERE rank <= 6),
        rest AS (SELECT q_id, chunk_id, document_title, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS nth FROM kept WHERE chunk_level = 'chapter'),
        filled AS (SELECT q_id, rank, chunk_id, score, document_title FROM six UNION ALL
          SELECT r.q_id, n + nth, chunk_id, score, document_title FROM rest r JOIN (SELECT a.q_id, count(s.q_id) AS n FROM asked a LEFT JOIN six s USING (q_id) GROUP BY a.q_id) USING (q_id) WHERE n + nth <= 6),
        m AS (SELECT *, {_MATCH} AS match, count(*) FILTER ({_MATCH}) OVER (PARTITION BY q_id) AS n FROM filled)
        SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY rank) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score, document_title FROM m WHERE match OR n < 3""",
    ),
    "r02_targeted_top": (targeted_lexical, f"WITH {_TARGETED}, r AS ({S.ranked('hits', 'score DESC')}) SELECT q_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 20"),
    "r18_reranked": (
        reranked,
        f"""WITH {S.VECTOR_HITS}, h AS (SELECT v.q_id, v.chunk_id, CAST(regexp_extract(v.chunk_id, '^(\\d+)-', 1) AS BIGINT) % 4 = 0 AS cached, list_distinct(regexp_extract_all(b.text, '\\S+')) AS asked_,
          list_distinct(regexp_extract_all(substring(document_title || chr(10) || coalesce(section_title, '') || chr(10) || {S.squeeze("v.text")}, 1, 1800), '\\S+')) AS words_
          FROM vhits v JOIN benchmark b ON b.item_id = v.q_id WHERE rank <= 30)
        SELECT q_id, chunk_id, cached, CASE WHEN cached THEN 0.5e0 ELSE round(round(len(list_intersect(asked_, words_)) / CAST(len(asked_) AS DOUBLE), 9), 6) END AS model_score FROM h""",
    ),
    "r21_variants": (
        variants,
        f"""WITH {S.LEXICAL}, {S.VECTOR_HITS.replace(S.CHUNKS + ",", "", 1)}, para AS (SELECT * FROM hits WHERE chunk_level <> 'chapter'),
        lex AS (SELECT q_id, chunk_id, rank AS l FROM ({S.ranked("para", "score DESC")})), v AS (SELECT q_id, chunk_id, rank AS r FROM vhits WHERE rank <= 80),
        f AS (SELECT q_id, chunk_id, round(coalesce(1e0 / (60 + l), 0) + coalesce(1e0 / (60 + r), 0), 9) AS score FROM (SELECT * FROM lex WHERE l <= 200) FULL JOIN v USING (q_id, chunk_id)),
        t AS (SELECT f.q_id, f.place, f.score, a.category, c.* FROM ({S.ranked("f", "score DESC", "place")}) f JOIN chunks c USING (chunk_id) JOIN asked a USING (q_id) WHERE place <= 30),
        re AS (SELECT q_id, chunk_id, round(score + {S.RERANK_BONUS}, 9) AS score FROM t)
        SELECT q_id, CAST(l AS INTEGER) AS rank, chunk_id, 'bm25' AS strategy FROM lex WHERE l <= 6
        UNION ALL SELECT q_id, rank, chunk_id, 'vector' FROM vhits WHERE rank <= 6
        UNION ALL SELECT q_id, place, chunk_id, 'hybrid' FROM t WHERE place <= 6
        UNION ALL SELECT q_id, rank, chunk_id, 'full' FROM ({S.ranked("re", "score DESC")}) WHERE rank <= 6""",
    ),
    "r22_compared_companies": (
        compared_companies,
        f"WITH {S.VECTOR_HITS} SELECT q_id, count(*) AS n, c AS company FROM vhits, (VALUES ('src1'), ('src2')) t(c) WHERE rank <= 10 AND contains(lower(document_title), c) GROUP BY q_id, c",
    ),
    "r23_warm_index": (warmed, f"WITH {S.INDEX} SELECT count(*) AS n_postings, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT token) AS n_tokens FROM postings"),
}
QUERIES["retrieve_lexical"] = QUERIES["r02_lexical_top"]
