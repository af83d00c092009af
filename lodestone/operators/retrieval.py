"""Retrieval for a table of questions at once: lexical scores, fusion, context and reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.functions import vocabulary as V
from lodestone.operators import scoring
from lodestone.operators.index import Index, own_bonus, searchable, whole
from lodestone.operators.vectors import best_matches
from lodestone.sources import shared


@dataclass(frozen=True)
class RetrievalConfig:
    """Every knob of retrieval; its fingerprint covers them all."""

    top_k: int = 6
    candidates: int = 30
    vector: bool = False
    rerank: bool = True
    rrf_k: int = 60
    lexical_candidates: int = 200
    vector_candidates: int = 80
    focus_k: int = 80
    fallback_limit: int = 40
    fallback_from: int = 20
    expansion_seeds: int = 12
    expansion_siblings: int = 4
    rerank_chars: int = 1800
    recall_weight: float = 0.5

    def fingerprint(self) -> Column:
        return F.sha2(F.lit(repr(sorted(asdict(self).items()))), 256)


#: The four strategies that are compared.
STRATEGIES = {
    "bm25": RetrievalConfig(rerank=False),
    "vector": RetrievalConfig(vector=True, rerank=False),
    "hybrid": RetrievalConfig(vector=True, rerank=False),
    "full": RetrievalConfig(vector=True, rerank=True),
}


def understood(questions: DataFrame) -> DataFrame:
    """Questions (q_id, question) with category, targets and query tokens; understood ones stay as they are."""
    if "tokens" in questions.columns:
        return questions
    q = F.col("question")
    told = questions.select("q_id", "question", Q.category(q).alias("category"), Q.target_terms(q).alias("targets"))
    told = told.withColumn("expanded", F.array_join(Q.expansion(q, F.col("category")), " "))
    metrics = T.tokens(F.lit(" ".join(V.METRIC_TERMS)))
    return told.select("q_id", "question", "category", "targets", Q.without_noise(T.tokens(F.col("expanded"))).alias("tokens"), Q.without_noise(F.concat(T.tokens(F.col("expanded")), metrics)).alias("focus_tokens"))


def target_bonus() -> Column:
    return F.when(F.size("targets") == 0, 0.0).when(Q.matches_targets(F.col("document_title"), F.col("targets")), 0.3).otherwise(-0.7)


def coverage(index: Index, questions: DataFrame, tokens: str = "tokens") -> DataFrame:
    """For each question and chunk with a common token: q_id, chunk_id, coverage, in_title, in_section; nothing is shuffled."""
    return scoring.scored(index, questions, tokens).drop("score", "chapter")


def with_terms(hits: DataFrame, chunks: DataFrame, index: Index, questions: DataFrame, tokens: str = "tokens", most: int = 10) -> DataFrame:
    """Hits with the common tokens that weigh most: terms. ``chunks`` has the hits' chunks; only theirs are cut into tokens."""
    asked = scoring.weighed(index, questions, tokens).select("q_id", "token", "idf")
    pairs = hits.select("q_id", "chunk_id")
    each = scoring.of(chunks, pairs).select("chunk_id", F.explode(F.array_distinct(T.tokens(whole()))).alias("token"))
    found = pairs.join(each, "chunk_id").join(asked, ["q_id", "token"])
    terms = found.groupBy("q_id", "chunk_id").agg(F.collect_list(F.struct((-F.col("idf")).alias("less"), "token")).alias("terms"))
    ordered = F.slice(F.transform(F.array_sort("terms"), lambda t: t["token"]), 1, most)
    return hits.join(terms.select("q_id", "chunk_id", ordered.alias("terms")), ["q_id", "chunk_id"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def category_place(name: Column) -> Column:
    return Q.by_category(name, {c: F.lit(k) for k, c in enumerate(Q.CATEGORIES)}, F.lit(0))


STATIC = ["chunk_id", "doc_id", "document_title", "section_title", "chunk_level", "page_start", "page_end", "parent_chunk_id"]


def _alone() -> Column:
    """What a chunk scores for a question's category without a common token."""
    return F.get("own", category_place(F.col("category"))) + target_bonus()


def scored_pairs(chunks: DataFrame, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores (9 decimals) of pairs (q_id, chunk_id, coverage, in_title, in_section), with the chunk's columns but its text; positive ones stay."""
    static = chunks.select(*STATIC, "own")
    rows = pairs.join(questions.select("q_id", "category", "targets"), "q_id").join(static, "chunk_id")
    hit = F.when(F.col("in_title"), 0.8).otherwise(0.0) + F.when(F.col("in_section"), 0.4).otherwise(0.0)
    score = F.round(3.0 * F.coalesce("coverage", F.lit(0.0)) + hit + _alone(), 9)
    return rows.withColumn("score", score).where("score > 0").select("q_id", "category", "targets", *STATIC, F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "score")


def lexical(index: Index, questions: DataFrame, most: int | None = None) -> DataFrame:
    """Scored chunks for understood questions: q_id, chunk_id, score (9 decimals), and the chunk's columns but its text.

    All hits, or, with ``most``, the first ``most`` paragraphs and the first ``most`` chapters of each question,
    by one pass over the chunks (see ``scoring.scored``); these few are kept, as they are read several times. A
    question with a true ``isolated`` (see ``with_isolation``) has its targets' chunks alone. Only
    positive scores stay.
    """
    pairs = scoring.scored(index, questions, "tokens", most, alone=True)
    if most is None:
        return scored_pairs(index.chunks, questions, pairs.drop("score", "chapter"))
    pairs = shared.kept(pairs)
    return shared.kept(scored_pairs(scoring.of(index.chunks, pairs), questions, pairs.drop("score", "chapter")))


def not_scored(index: Index, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (q_id, chunk_id, ...) those whose chunk is no hit of its question, however low."""
    asked = questions.join(pairs.select("q_id").distinct(), "q_id", "left_semi")
    found = coverage(index, asked).join(pairs.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "right")
    hits = scored_pairs(index.chunks, questions, found).select("q_id", "chunk_id")
    return pairs.join(hits, ["q_id", "chunk_id"], "left_anti")


def target_titles(questions: DataFrame, chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The titles that each set of targets matches, with their number of chunks (an index has these as its ``titles``): targets, document_title, n."""
    sets = questions.where(F.size("targets") > 0).select("targets").distinct()
    terms = sets.select(F.explode("targets").alias("term")).distinct()
    titles = chunks.groupBy("document_title").agg(F.count("*").alias("n")) if titles is None else titles
    named = titles.join(terms, F.contains(F.lower("document_title"), F.col("term"))).select("term", "document_title", "n")
    return sets.select("targets", F.explode("targets").alias("term")).join(named, "term").select("targets", "document_title", "n").distinct()


def ranked(hits: DataFrame, *order: Column, most: int | None = None, name: str = "rank") -> DataFrame:
    """Hits with their rank by question; ties end with chunk_id."""
    out = hits.withColumn(name, F.row_number().over(Window.partitionBy("q_id").orderBy(*order, "chunk_id")))
    return out if most is None else out.where(F.col(name) <= most)


def isolated(hits: DataFrame, top_k: int) -> DataFrame:
    """Only target documents' hits, for questions with targets that at least twice top_k of the given hits match.

    ``retrieve`` counts chunks of the corpus instead: see ``with_isolation``.
    """
    match = (F.size("targets") > 0) & Q.matches_targets(F.col("document_title"), F.col("targets"))
    n = F.count_if("match__").over(Window.partitionBy("q_id"))
    out = hits.withColumn("match__", match).withColumn("n__", n)
    return out.where(F.col("match__") | (F.col("n__") < 2 * top_k)).drop("match__", "n__")


def with_isolation(questions: DataFrame, chunks: DataFrame, top_k: int, titles: DataFrame | None = None) -> DataFrame:
    """Questions with ``isolated``: whether they have targets that at least twice top_k chunks of the corpus match."""
    found = target_titles(questions, chunks, titles).groupBy("targets").agg(F.sum("n").alias("n__"))
    enough = F.coalesce(F.col("n__") >= 2 * top_k, F.lit(False))
    return questions.join(found, "targets", "left").withColumn("isolated", enough).select(*questions.columns, "isolated")


def category_fallback(hits: DataFrame, index: Index, questions: DataFrame, config: RetrievalConfig, complete: bool = True) -> DataFrame:
    """Paragraphs of target documents with a category term that aren't hits yet, below the top_k-th score: q_id, chunk_id, score.

    ``hits`` has all hits, or, if it isn't ``complete``, the first lexical ones.
    """
    if config.top_k < config.fallback_from:
        return hits.select("q_id", "chunk_id", "score").limit(0)
    floor = ranked(hits, F.desc("score"), most=config.top_k).groupBy("q_id").agg(F.min("score").alias("floor"))
    asked = questions.where(F.size("targets") > 0).select("q_id", "category", "targets")
    aimed = asked.join(target_titles(questions, index.chunks, index.titles).drop("n"), "targets")
    rows = index.chunks.where("chunk_level <> 'chapter'").join(F.broadcast(aimed), "document_title")
    rows = rows.withColumn("hits", Q.category_hits(F.lower(searchable()), F.col("category"))).where("hits > 0").select("q_id", "chunk_id", "hits", "page_start").join(F.broadcast(hits.select("q_id", "chunk_id")), ["q_id", "chunk_id"], "left_anti")
    rows = rows if complete else not_scored(index, questions, rows)
    order = Window.partitionBy("q_id").orderBy(F.desc("hits"), F.desc(F.coalesce("page_start", F.lit(0))), "chunk_id")
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= config.fallback_limit).withColumn("nth", F.col("nth") - 1).join(floor, "q_id", "left")
    return rows.select("q_id", "chunk_id", (F.coalesce("floor", F.lit(0.3)) - 0.2 - 0.002 * F.col("nth") + F.least(F.lit(0.2), 0.04 * F.col("hits"))).alias("score"))


def context_expansion(hits: DataFrame, chunks: DataFrame, questions: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Siblings and same-page neighbours of the first hits that aren't hits yet: q_id, chunk_id, score, seed.

    Of several seeds the first wins.
    """
    seeds = ranked(hits, F.desc("score"), most=config.expansion_seeds, name="seed_no")
    seeds = seeds.select("q_id", "seed_no", F.col("chunk_id").alias("seed"), F.col("score").alias("seed_score"), F.col("parent_chunk_id").alias("parent"), F.col("document_title").alias("title"), F.col("page_start").alias("first"), F.col("page_end").alias("last"))
    seeds = seeds.join(questions.select("q_id", "category"), "q_id")
    near = chunks.where("chunk_level <> 'chapter'")
    asked = [r.category for r in questions.select("category").distinct().collect()]
    told = F.create_map(*(x for c in asked for x in (F.lit(c), Q.category_hits(F.lower(searchable()), F.lit(c))))) if asked else F.lit(None).cast("map<string,int>")
    near = near.select("chunk_id", "parent_chunk_id", "document_title", "page_start", "page_end", told.alias("hits_of"))
    seeds = F.broadcast(shared.kept(seeds))  # few: a stated set of questions' first hits
    ways = [near.join(seeds, near.parent_chunk_id == seeds.parent).withColumn("way", F.lit(0)), near.join(seeds, (near.document_title == seeds.title) & near.page_start.eqNullSafe(seeds["first"]) & near.page_end.eqNullSafe(seeds["last"])).withColumn("way", F.lit(1))]
    order = Window.partitionBy("q_id", "seed", "way").orderBy(F.desc("hits"), "chunk_id")
    rows = ways[0].unionByName(ways[1]).select("q_id", "seed_no", "seed", "seed_score", "way", "chunk_id", F.element_at("hits_of", F.col("category")).alias("hits"))
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= config.expansion_siblings).join(hits.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti")
    first = Window.partitionBy("q_id", "chunk_id").orderBy("seed_no", "way")
    score = F.round(F.col("seed_score") - 0.12 - 0.01 * (F.col("seed_no") - 1) + F.least(F.lit(0.18), 0.04 * F.col("hits")), 9)
    return rows.withColumn("first", F.row_number().over(first)).where("first = 1").select("q_id", "chunk_id", score.alias("score"), "seed")


def fused(lexical_hits: DataFrame, vector_hits: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Reciprocal-rank fusion: q_id, chunk_id, tier, score.

    Tier 0 has the fused scores of the first lexical and vector candidates; the lexical tail follows
    in tier 1 with its own scores, which aren't compared with the fused ones.
    """
    lexical_rank = ranked(lexical_hits, F.desc("score"), name="lexical_rank").select("q_id", "chunk_id", "score", "lexical_rank")
    vector_rank = vector_hits.where(F.col("rank") <= config.vector_candidates).select("q_id", "chunk_id", F.col("rank").alias("vector_rank"))
    head = lexical_rank.where(F.col("lexical_rank") <= config.lexical_candidates)
    part = lambda c: F.coalesce(1.0 / (config.rrf_k + F.col(c)), F.lit(0.0))
    both = head.join(vector_rank, ["q_id", "chunk_id"], "full_outer").select("q_id", "chunk_id", F.lit(0).alias("tier"), F.round(part("lexical_rank") + part("vector_rank"), 9).alias("score"))
    tail = lexical_rank.join(both, ["q_id", "chunk_id"], "left_anti").select("q_id", "chunk_id", F.lit(1).alias("tier"), "score")
    return both.unionByName(tail)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors by cosine distance: q_id, chunk_id, distance (9 decimals), rank; ties go to the smaller chunk_id.

    ``queries`` (q_id, embedding) is a stated set: see ``vectors.best_matches``.
    """
    rows = best_matches(vectors.select(F.col("chunk_id").alias("id"), F.lit(1.0).alias("weight"), "embedding"), queries, k)
    return rows.select("q_id", F.col("id").alias("chunk_id"), (F.round(1 - F.col("similarity"), 9) + 0.0).alias("distance"), "rank")


def is_financial(section: Column) -> Column:
    return T.contains_any(F.coalesce(section, F.lit("")), V.FINANCIAL_SECTIONS)


def financial_part(index: Index) -> Index:
    """The paragraphs of financial sections, with the frequencies of the whole corpus."""
    chunks = index.chunks.where("chunk_level <> 'chapter'").where(is_financial(F.col("section_title")))
    return Index(chunks, index.idf, index.totals, index.titles)


def financial_focus(index: Index, questions: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Financial questions' best paragraphs of financial sections, by focus tokens: q_id, chunk_id, score."""
    asked = questions.where("category = 'financial'").withColumn("tokens", F.col("focus_tokens"))
    most = max(config.top_k, config.focus_k)
    return ranked(lexical(financial_part(index), asked, most), F.desc("score"), most=most).select("q_id", "chunk_id", "score")


def focused_first(hits: DataFrame, top_k: int) -> DataFrame:
    """Hits of financial sections before others (column tier), if there are enough; by score and metric bonus."""
    n = F.count_if("focused").over(Window.partitionBy("q_id"))
    out = hits.withColumn("focused", is_financial(F.col("section_title"))).withColumn("n__", n)
    return out.withColumn("tier", F.when(F.col("focused") & (F.col("n__") >= max(3, top_k // 2)), 0).otherwise(1)).withColumn("focus_score", F.col("score") + F.when(F.col("tier") == 0, Q.metric_bonus(searchable())).otherwise(0.0)).drop("n__", "focused")


def with_focus(order: DataFrame, index: Index, questions: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Financial questions' hits of financial sections before others: q_id, chunk_id, tier, score, by (the score to order by).

    Those by focus tokens come first; with enough hits of financial sections, all of these do, by
    score and metric bonus. Without vectors every lexical hit of a financial section counts.
    """
    focus = financial_focus(index, questions, config).withColumn("tier", F.lit(0))
    if not config.vector:
        more = lexical(financial_part(index), questions.where("category = 'financial'")).select("q_id", "chunk_id", F.lit(1).alias("tier"), "score")
        order = order.unionByName(more.join(order.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti"))
    order = focus.unionByName(order.join(focus.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti"))
    order = shared.kept(order)
    bonus = scoring.of(index.chunks, order).where("chunk_level <> 'chapter'").where(is_financial(F.col("section_title"))).select("chunk_id", Q.metric_bonus(searchable()).alias("bonus"))
    rows = order.join(questions.select("q_id", "category"), "q_id").join(bonus, "chunk_id", "left")
    focused = (F.col("category") == "financial") & F.col("bonus").isNotNull()
    enough = F.count_if(focused).over(Window.partitionBy("q_id")) >= max(3, config.top_k // 2)
    first = focused & enough
    return rows.withColumn("first__", first).select("q_id", "chunk_id", F.when(F.col("first__"), F.lit(-1)).otherwise(F.col("tier")).alias("tier"), "score", F.when(F.col("first__"), F.round(F.col("score") + F.col("bonus"), 9)).otherwise(F.col("score")).alias("by"))


def rerank_bonus() -> Column:
    """The heuristic bonus of a hit in its question's category."""
    text, section = T.squeeze(F.lower("text")), F.lower(F.coalesce("section_title", F.lit("")))
    whole = F.concat_ws(" ", F.lower("document_title"), section, text)
    name = F.col("category")
    preferred = Q.by_category(name, {k: T.contains_any(section, terms) for k, terms in V.PREFERRED_SECTIONS.items()}, F.lit(False))
    phrases = Q.by_category(name, {k: T.count_contained(whole, [t for t in terms if " " in t]) for k, terms in V.REWRITE_TERMS.items()}, F.lit(0))
    front = (F.col("page_start") == 1) & T.contains_any(section, ["annual report", "notes", "contents"])
    return (
        F.least(F.lit(0.45), 0.08 * Q.category_hits(whole, name))
        + F.when(preferred, 0.35).otherwise(0.0)
        - F.when(T.contains_any(section, V.NOISY_SECTIONS), 0.15).otherwise(0.0)
        - F.when(front, 0.12).otherwise(0.0)
        + F.when(text.rlike(r"\b(20\d{2}|\d+(?:\.\d+)?%|\$?\d+(?:,\d{3})*(?:\.\d+)?)\b"), 0.08).otherwise(0.0)
        - F.when(F.char_length(text) < 120, 0.08).otherwise(0.0)
        + F.least(F.lit(0.25), 0.08 * phrases)
    )


def blended(hits: DataFrame, recall_weight: float = 0.5) -> DataFrame:
    """Model and recall scores, each scaled to its question's range (0.5 where all are equal), as one: blend."""
    over = Window.partitionBy("q_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(over), F.max(c).over(over)
        return F.when(high <= low, 0.5).otherwise((F.col(c) - low) / (high - low))

    return hits.withColumn("blend", F.round((1 - recall_weight) * scaled("model_score") + recall_weight * scaled("score"), 9))


def candidate_text(most: int = 1800) -> Column:
    return F.substring(F.concat_ws("\n", "document_title", F.coalesce("section_title", F.lit("")), T.squeeze(F.col("text"))), 1, most)


#: Scores of pairs that a model has given: one row for a question's hash, a chunk and a model's name.
PAIRS = "query_hash string, chunk_id string, model string, score double"


@dataclass(frozen=True)
class Reranker:
    """A model of pairs: ``score`` takes questions and texts (two series) and gives their scores; ``cache`` has known ones (PAIRS)."""

    name: str
    score: Callable[[pd.Series, pd.Series], pd.Series]
    cache: DataFrame | None = None

    def scored(self, pairs: DataFrame, most: int = 1800) -> DataFrame:
        """Pairs (question, chunk_id and the chunk's columns) with model_score, and whether it was cached.

        The model sees only the pairs that the cache lacks, in Arrow batches.
        """
        score = F.pandas_udf(self.score, "double")
        rows = pairs.withColumn("query_hash", Q.query_hash(F.col("question")))
        if self.cache is None:
            return rows.withColumn("cached", F.lit(False)).withColumn("model_score", score("question", candidate_text(most)))
        known = self.cache.where(F.col("model") == self.name).select("query_hash", "chunk_id", F.col("score").alias("known"))
        rows = rows.join(known, ["query_hash", "chunk_id"], "left").withColumn("cached", F.col("known").isNotNull())
        asked = rows.where("not cached").withColumn("model_score", score("question", candidate_text(most)))
        return rows.where("cached").withColumn("model_score", F.col("known")).unionByName(asked).drop("known")

    def next_cache(self, scored: DataFrame) -> DataFrame:
        """The next generation of the cache: what it had, and the new scores."""
        new = scored.where("not cached").select("query_hash", "chunk_id", F.lit(self.name).alias("model"), F.col("model_score").alias("score")).distinct()
        return new if self.cache is None else self.cache.unionByName(new)


def retrieve(index: Index, questions: DataFrame, config: RetrievalConfig = RetrievalConfig(), vectors: DataFrame | None = None, reranker: Reranker | None = None) -> DataFrame:
    """The final hits of each question: q_id, rank, chunk_id, score, terms and the chunk's columns.

    Ranks are dense and chunks stand once. Financial sections come first for financial questions; a
    heuristic bonus or a ``reranker``'s blended scores order the first candidates anew. Paragraphs come
    first, chapters fill up to top_k; a question with targets gets theirs alone if at least min(3,
    top_k) hits match. Questions are (q_id, question); ``vectors`` (q_id, chunk_id, rank) are used if
    the configuration says so.
    """
    asked = shared.kept(with_isolation(understood(questions), index.chunks, config.top_k, index.titles))
    most = max(config.top_k, config.candidates) + (config.lexical_candidates if config.vector else 0)
    scored = lexical(index, asked, most)
    paragraphs = ranked(scored.where("chunk_level <> 'chapter'"), F.desc("score"), most=most).drop("rank")
    order = paragraphs.select("q_id", "chunk_id", F.lit(1).alias("tier"), "score")
    if config.top_k >= config.fallback_from:
        order = order.unionByName(category_fallback(paragraphs, index, asked, config, complete=False).withColumn("tier", F.lit(1)))
        seeds = ranked(order.drop("tier"), F.desc("score"), most=config.expansion_seeds).drop("rank")
        seeds = seeds.join(scoring.of(index.chunks, seeds), "chunk_id")
        near = not_scored(index, asked, context_expansion(seeds, index.chunks, asked, config))
        near = near.join(order.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti")
        order = order.unionByName(near.drop("seed").withColumn("tier", F.lit(1)))
    if config.vector and vectors is not None:
        titles = scoring.of(index.chunks, vectors).select("chunk_id", "document_title")
        vectors = vectors.join(titles, "chunk_id", "left").join(asked.select("q_id", "isolated", "targets"), "q_id", "left")
        vectors = vectors.where(~F.coalesce("isolated", F.lit(False)) | Q.matches_targets(F.col("document_title"), F.col("targets"))).select("q_id", "chunk_id", "rank")
        order = fused(order.drop("tier"), vectors, config).withColumn("tier", F.col("tier") + 1)
    order = with_focus(order, index, asked, config)
    first = shared.kept(ranked(order, F.col("tier"), F.desc("by"), most=max(config.top_k, config.candidates), name="place"))
    chapters = ranked(scored.where("chunk_level = 'chapter'"), F.desc("score"), most=config.top_k).select("q_id", "chunk_id", "score", "document_title", "targets")
    known = shared.kept(scoring.of(index.chunks.drop("own"), first.select("chunk_id").union(chapters.select("chunk_id"))))  # the candidates' chunks, cut once
    rows = first.join(known, "chunk_id").join(asked.select("q_id", "question", "category", "targets"), "q_id")
    if config.rerank and reranker is not None:
        rows = blended(reranker.scored(rows, config.rerank_chars), config.recall_weight).withColumn("score", F.col("blend"))
        rows = ranked(rows, F.desc("score"), F.col("place"), most=config.top_k)
    elif config.rerank:
        rows = rows.withColumn("score", F.round(F.col("score") + rerank_bonus(), 9))
        rows = ranked(rows, F.desc("score"), most=config.top_k)
    else:
        rows = ranked(rows, F.col("tier"), F.desc("by"), most=config.top_k)
    rows = completed(rows.select("q_id", "chunk_id", "score", "document_title", "targets", "rank"), chapters, config.top_k)
    rows = rows.select("q_id", "rank", "chunk_id", "score").join(known, "chunk_id")
    rows = with_terms(rows, known, index, asked)
    return rows.select("q_id", "rank", "chunk_id", "score", "terms", "document_title", "section_title", "chunk_level", "page_start", "page_end", "text", "doc_id")


def completed(rows: DataFrame, chapters: DataFrame, top_k: int) -> DataFrame:
    """Ranked hits (q_id, rank, chunk_id, document_title, targets), filled up to top_k with chapters by their scores; then only
    targets' hits, where at least min(3, top_k) are. Ranks stay dense; both tables have the same columns but the chapters' rank."""
    extra = ranked(chapters, F.desc("score"), most=top_k)
    both = rows.withColumn("extra__", F.lit(0)).unionByName(extra.withColumn("extra__", F.lit(1)))
    once = Window.partitionBy("q_id", "chunk_id").orderBy("extra__", "rank")
    both = both.withColumn("nth__", F.row_number().over(once)).where("nth__ = 1").drop("nth__")
    order = Window.partitionBy("q_id").orderBy("extra__", "rank")
    both = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("extra__")
    match = (F.size("targets") > 0) & Q.matches_targets(F.col("document_title"), F.col("targets"))
    n = F.count_if("match__").over(Window.partitionBy("q_id"))
    left = both.withColumn("match__", match).withColumn("n__", n).where(F.col("match__") | (F.col("n__") < min(3, top_k))).drop("match__", "n__")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank")))


def for_company(hits: DataFrame, company: str) -> DataFrame:
    """Hits whose title contains a name, as the comparison of companies filters them after the top."""
    return hits.where(F.contains(F.lower("document_title"), F.lower(F.lit(company))))
