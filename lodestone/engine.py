"""One object over a corpus: index, retrieve, answer and evaluate tables of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.operators import answers, evaluation, retrieval, state
from lodestone.operators.index import Index, fingerprint, shared_index
from lodestone.sources import shared

#: Limits of a request: characters of a question and number of hits.
QUESTION_CHARS, MOST_HITS = 2000, 20


#: An answer as it is cached: by the question's hash, the configuration's and the corpus.
ANSWERS = "cache_key string, question string, prompt string, answer string, sources array<string>, chunk_ids array<string>, used_model boolean, backend string, expires_at timestamp"
#: The days that an answer stays fresh.
ANSWER_DAYS = 7


@dataclass(frozen=True)
class Engine:
    """Answers questions (q_id, question) over an index that is written once for each corpus.

    ``model`` answers prompts and ``reranker`` scores pairs; without them answers are extracted and
    hits are ordered by heuristics.
    """

    index: Index
    model: Callable[[pd.Series], pd.Series] | None = None
    reranker: retrieval.Reranker | None = None

    @classmethod
    def over(cls, docs: DataFrame, **hooks) -> Engine:
        """An engine over documents (doc_id, text, lang, source)."""
        return cls(shared_index(docs, shared.shared_folder(docs.sparkSession)), **hooks)

    def _understood(self, questions: DataFrame) -> DataFrame:
        valid = questions.where(F.char_length("question").between(1, QUESTION_CHARS))
        return valid if "tokens" in valid.columns else shared.kept(retrieval.understood(valid))

    def retrieve(self, questions: DataFrame, config: retrieval.RetrievalConfig = retrieval.RetrievalConfig(), vectors: DataFrame | None = None) -> DataFrame:
        """Hits of questions; those without text or longer than QUESTION_CHARS characters have none."""
        if not 1 <= config.top_k <= MOST_HITS:
            raise ValueError(f"top_k must be from 1 to {MOST_HITS}")
        return retrieval.retrieve(self.index, self._understood(questions), config, vectors, self.reranker)

    def ask(self, questions: DataFrame, config: retrieval.RetrievalConfig = retrieval.RetrievalConfig(), vectors: DataFrame | None = None) -> DataFrame:
        """Each valid question's answer: see ``answers.composed``."""
        asked = self._understood(questions)
        hits = shared.kept(self.retrieve(asked, config, vectors))
        return answers.composed(hits, asked, self.model)

    def ask_cached(self, questions: DataFrame, cache: DataFrame, as_of: Column, config: retrieval.RetrievalConfig = retrieval.RetrievalConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Answers with ``cached``, the cache's next generation (ANSWERS), and a log of the new answers.

        Only questions without a fresh entry are answered; of equal questions the least id is.
        """
        key = F.sha2(F.concat_ws("|", Q.query_hash(F.col("question")), config.fingerprint(), F.lit(self.corpus())), 256)
        valid = questions.where(F.char_length("question").between(1, QUESTION_CHARS)).withColumn("cache_key", key)
        live = cache.where(state.fresh(as_of)).drop("question", "expires_at")
        found = valid.join(live, "cache_key")
        missing = valid.join(live.select("cache_key"), "cache_key", "left_anti")
        first = missing.groupBy("cache_key").agg(F.min_by("question", "q_id").alias("question"), F.min("q_id").alias("q_id"))
        new = shared.kept(self.ask(first.select("q_id", "question"), config).join(first.select("q_id", "cache_key"), "q_id"))
        told = missing.join(new.drop("q_id", "question"), "cache_key").withColumn("cached", F.lit(False))
        rows = found.withColumn("cached", F.lit(True)).unionByName(told)
        columns = [c.split()[0] for c in ANSWERS.split(", ")]
        after = state.upserted(cache, new.withColumn("expires_at", state.expires(as_of, ANSWER_DAYS)).select(columns), ["cache_key"])
        log = new.select(F.col("question").alias("query_text"), F.col("chunk_ids").alias("retrieved_chunk_ids"), F.col("answer").alias("answer_text"), "used_model", "prompt", F.size("sources").alias("source_count"), as_of.alias("created_at"))
        return rows.drop("cache_key"), after, log

    def corpus(self) -> str:
        """The chunks by their ids and texts."""
        return fingerprint(self.index.chunks, "chunk_id", "text")

    def retrieve_docs(self, questions: DataFrame, top_k: int = 6) -> DataFrame:
        """The agent's search: up to ten hits."""
        return self.retrieve(questions, retrieval.RetrievalConfig(top_k=min(top_k, 10)))

    def _of_company(self, asked: DataFrame, top_k: int) -> DataFrame:
        """Hits of rows (q_id, name, question) whose titles contain the name; they are filtered after the top."""
        hits = self.retrieve(asked.select("q_id", "question"), retrieval.RetrievalConfig(top_k=top_k))
        return hits.join(asked.select("q_id", "name"), "q_id").where(F.contains(F.lower("document_title"), F.lower("name")))

    def compare_companies(self, asked: DataFrame) -> DataFrame:
        """Two companies' hits, four each, for rows (q_id, company_a, company_b, aspect)."""
        sides = [asked.select(F.concat(F.col("q_id").cast("string"), F.lit(side)).alias("q_id"), F.col(f"company_{side}").alias("name"), F.concat_ws(" ", f"company_{side}", "aspect").alias("question")) for side in "ab"]
        return self._of_company(sides[0].unionByName(sides[1]), 4)

    def extract_financials(self, asked: DataFrame) -> DataFrame:
        """A company's hits for a metric and a year (or ""), five, for rows (q_id, company, metric, year)."""
        question = F.concat_ws(" ", "company", F.when(F.col("year") != "", F.col("year")), "metric", F.lit("financial results annual report"))
        return self._of_company(asked.select("q_id", F.col("company").alias("name"), question.alias("question")), 5)

    def summarize_document(self, asked: DataFrame) -> DataFrame:
        """Eight hits that stand for a document, for rows (q_id, document)."""
        question = F.concat_ws(" ", "document", F.lit("key findings overview summary"))
        return self._of_company(asked.select("q_id", F.col("document").alias("name"), question.alias("question")), 8)

    def evaluate(self, cases: DataFrame, config: retrieval.RetrievalConfig = retrieval.RetrievalConfig()) -> DataFrame:
        """Metrics over cases (q_id, question, gold_doc, gold_first, gold_last, keywords)."""
        hits = shared.kept(self.retrieve(cases.select("q_id", "question"), config))
        ranks = evaluation.first_ranks(cases, hits)
        found = evaluation.keyword_hits(cases, hits)
        return evaluation.metrics(ranks.join(found, "q_id", "left").withColumn("keyword_hit", F.coalesce("keyword_hit", F.lit(False))))
