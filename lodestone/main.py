"""The engine from a shell: spark-submit lodestone/main.py COMMAND ... (answer, evaluate, tune, analyse, seed, embed, repair, chat)."""

from __future__ import annotations

import argparse
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import agent, corpus, evaluation, retrieval, vectors
from lodestone.sources import readers, shared, tables


def answer(spark: SparkSession, docs: str, questions: str, out: str) -> None:
    """Answer a table of questions (q_id, question)."""
    Engine.over(spark.read.parquet(docs)).ask(spark.read.parquet(questions)).write.parquet(out)


def _cases(spark: SparkSession, path: str) -> DataFrame:
    rows = readers.read_cases(spark, path)
    return rows.select(F.col("id").alias("q_id"), "question", "gold_doc", F.get("gold_page_range", 0).alias("gold_first"), F.get("gold_page_range", 1).alias("gold_last"), F.col("expected_keywords").alias("keywords"))


def evaluate(spark: SparkSession, docs: str, cases: str, out: str) -> None:
    """Metrics of each strategy over a golden set."""
    engine, told = Engine.over(spark.read.parquet(docs)), shared.kept(_cases(spark, cases))
    parts = [engine.evaluate(told, config).withColumn("strategy", F.lit(name)) for name, config in retrieval.STRATEGIES.items() if not config.vector]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows.write.parquet(out)


def tune(spark: SparkSession, docs: str, cases: str, out: str) -> None:
    """Metrics for numbers of candidates, with and without reranking."""
    engine, told, rows = Engine.over(spark.read.parquet(docs)), shared.kept(_cases(spark, cases)), None
    for candidates, rerank in product((20, 30, 50), (False, True)):
        part = engine.evaluate(told, retrieval.RetrievalConfig(candidates=candidates, rerank=rerank)).withColumn("candidates", F.lit(candidates)).withColumn("rerank", F.lit(rerank))
        rows = part if rows is None else rows.unionByName(part)
    rows.write.parquet(out)


def analyse(spark: SparkSession, docs: str, cases: str, out: str) -> None:
    """The first rank of each case's document and page."""
    told = shared.kept(_cases(spark, cases))
    hits = shared.kept(Engine.over(spark.read.parquet(docs)).retrieve(told.select("q_id", "question"), retrieval.RetrievalConfig(top_k=20)))
    evaluation.first_ranks(told, hits).write.parquet(out)


def seed(spark: SparkSession, files: str, out: str) -> None:
    """Documents and chunks of a folder of markdown files."""
    rows = spark.read.text(files, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    documents, parts = corpus.seeded(rows)
    documents.write.parquet(f"{out}/documents")
    parts.write.parquet(f"{out}/chunks")


def embed(spark: SparkSession, docs: str, done: str, out: str) -> None:
    """Embeddings of the documents that a table (doc_id, model) lacks, by the stand-in model."""
    vectors.embed(vectors.to_embed(spark.read.parquet(docs), spark.read.parquet(done), "hash-1024"), vectors.hash_model(1024), 1024).write.parquet(out)


def repair(spark: SparkSession, folder: str, out: str) -> None:
    """A folder's tables with all columns that they are meant to have; those that it lacks are made."""
    paths = tables.bootstrap(spark, folder)
    for name in paths:
        tables.opened(spark, folder, name).write.parquet(f"{out}/{name}")


def chat(spark: SparkSession, docs: str, questions: str, folder: str, out: str) -> None:
    """One turn of threads: questions (q_id, thread_id, user_id, question); the next threads and memories go to the new folder too."""
    tables.bootstrap(spark, folder)
    threads, memories = (tables.opened(spark, folder, name) for name in ("threads", "memories"))
    found = agent.chat(Engine.over(spark.read.parquet(docs)), spark.read.parquet(questions), threads, memories, F.current_timestamp())
    for name, rows in zip(("answers", "threads", "memories"), found, strict=True):
        rows.write.parquet(f"{out}/{name}")


COMMANDS = (answer, evaluate, tune, analyse, seed, embed, repair, chat)


def main(told: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for command in COMMANDS:
        own = commands.add_parser(command.__name__, help=command.__doc__)
        for name in command.__code__.co_varnames[1 : command.__code__.co_argcount]:
            own.add_argument(name)
    args = vars(parser.parse_args(told))
    {c.__name__: c for c in COMMANDS}[args.pop("command")](SparkSession.builder.getOrCreate(), **args)


if __name__ == "__main__":
    main()
