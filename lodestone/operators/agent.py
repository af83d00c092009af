"""The agent's steps for a table of questions: recall, intent, route, answer, save; all questions take each step together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.functions import vocabulary as V
from lodestone.operators import state
from lodestone.operators.retrieval import RetrievalConfig

#: Hits that each agent asks for, and the characters of an observation that a model reads.
TOP_K = {"financial_agent": 6, "comparison_agent": 4, "summary_agent": 8, "react_planner": 6}
OBSERVED_CHARS = 2000
#: Rounds of searching that the planner takes at most.
ROUNDS = 5


def recalled(questions: DataFrame, memories: DataFrame, most: int = 4) -> DataFrame:
    """Questions with their user's most important, then newest memories as one text: ..., memory_context.

    Memories are (user_id, memory_id, content, importance, created_at). Similarity recall over
    embeddings is ``vectors.recalled``.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("created_at"), "memory_id")
    best = memories.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    context = best.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "content"))), lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("memory_context"))
    return questions.join(context, "user_id", "left").withColumn("memory_context", F.coalesce("memory_context", F.lit("")))


def classified(questions: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Questions with intent and agent. A model names intents, in Arrow batches; an unknown one, or none, is general.

    Without a model the question's category tells its intent.
    """
    if model is None:
        name = Q.category(F.col("question"))
        intent = F.when(name.isin("financial", "market"), name).when(name == "technology", "technical").otherwise("general")
    else:
        intent = F.lower(F.trim(F.pandas_udf(model, "string")("question")))
    known = F.create_map(*(F.lit(x) for pair in V.INTENT_AGENTS.items() for x in pair))
    told = questions.withColumn("intent", intent).withColumn("agent", F.get(F.array(F.try_element_at(known, F.col("intent"))), 0))
    general = F.col("agent").isNull()
    return told.withColumn("intent", F.when(general, "general").otherwise(F.col("intent"))).withColumn("agent", F.coalesce("agent", F.lit(V.INTENT_AGENTS["general"])))


def answered(engine: Engine, questions: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Answers of classified questions, each by its agent's number of hits: q_id, answer, sources, agent, intent."""
    parts = None
    for agent, top_k in TOP_K.items():
        asked = questions.where(F.col("agent") == agent)
        rows = engine.ask(asked.select("q_id", "question"), replace(config, top_k=top_k)).select("q_id", "answer", "sources")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.join(questions.select("q_id", "agent", "intent"), "q_id")


def planned(engine: Engine, questions: DataFrame, planner: Callable[[pd.Series], pd.Series], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Rounds of searching by a planner's model: q_id, question, observations, final.

    In each round the planner reads the question and what was observed, and gives the next search, or
    "FINAL: " and an answer. An observation is cut at OBSERVED_CHARS characters; after ROUNDS rounds,
    questions without an answer have a null one.
    """
    from lodestone.sources import shared

    plan = F.pandas_udf(planner, "string")
    rows = questions.select("q_id", "question", F.array().cast("array<string>").alias("observations"), F.lit(None).cast("string").alias("final"))
    for _ in range(ROUNDS):
        told = rows.withColumn("step", F.when(F.col("final").isNull(), plan(F.concat_ws("\n\n", "question", F.array_join("observations", "\n\n")))))
        ended = F.startswith("step", F.lit("FINAL: "))
        told = shared.kept(told.withColumn("final", F.coalesce("final", F.when(ended, F.substring("step", 8, 1_000_000)))))
        searching = told.where("final is null and coalesce(step, '') <> ''").select("q_id", F.col("step").alias("question"))
        if searching.isEmpty():
            rows = told.drop("step")
            break
        seen = context(engine.retrieve(searching, config))
        found = told.join(seen, "q_id", "left").withColumn("observations", F.when(F.col("context").isNull(), F.col("observations")).otherwise(F.concat("observations", F.array("context"))))
        rows = shared.kept(found.drop("step", "context"))
    return rows


def context(hits: DataFrame) -> DataFrame:
    """A question's hits as a model reads them: q_id, context, cut at OBSERVED_CHARS characters."""
    shown = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.citation(F.col("document_title"), F.col("page_start"), F.col("page_end")), F.lit("\n"), F.col("text"))
    rows = hits.groupBy("q_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", shown.alias("shown")))), lambda x: x["shown"]), "\n\n").alias("context"))
    cut = F.char_length("context") > OBSERVED_CHARS
    return rows.select("q_id", F.when(cut, F.concat(F.substring("context", 1, OBSERVED_CHARS), F.lit("\n...[truncated]"))).otherwise(F.col("context")).alias("context"))


def saved(threads: DataFrame, memories: DataFrame, answers: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Threads (thread_id, user_id, title, intent, updated_at) and memories after answered questions.

    ``answers`` has thread_id, user_id, question, answer and intent; questions without an answer leave
    nothing. A thread keeps its first title; each long line of an answer may become a memory.
    """
    told = answers.where("coalesce(answer, '') <> ''")
    known = threads.select("thread_id", F.col("title").alias("first_title"))
    new = told.groupBy("thread_id").agg(F.min("user_id").alias("user_id"), F.min_by("question", "q_id").alias("question"), F.max_by("intent", "q_id").alias("intent")).join(known, "thread_id", "left")
    new = new.select("thread_id", "user_id", F.coalesce("first_title", F.substring("question", 1, 80)).alias("title"), "intent", as_of.alias("updated_at"))
    turns = told.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("q_id").cast("string")).alias("thread_id"), F.col("q_id").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    lines = state.remembered(turns).select(F.concat_ws("/", "thread_id", F.col("nth").cast("string")).alias("memory_id"), F.regexp_extract("thread_id", "^(.*)/", 1).alias("user_id"), "content", "importance", as_of.alias("created_at"))
    return state.upserted(threads, new, ["thread_id"]), state.added(memories, lines.select(memories.columns), ["memory_id"])


def chat(engine: Engine, questions: DataFrame, threads: DataFrame, memories: DataFrame, as_of, intents: Callable[[pd.Series], pd.Series] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One turn of many threads: questions (q_id, thread_id, user_id, question) to answers, and the next threads and memories."""
    told = classified(recalled(questions, memories), intents)
    rows = answered(engine, told).join(told.select("q_id", "thread_id", "user_id", "question", "memory_context"), "q_id")
    return (rows, *saved(threads, memories, rows, as_of))
