"""The engine's own tables: their columns, and their making and widening in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns by table.
TABLES = {
    "documents": "document_key string, file_hash string, title string, file_name string, doc_type string, language string, status string, seq long",
    "document_versions": "document_key string, version_no long, content_hash string, seq long",
    "chunks": "chunk_id string, document_key string, chunk_index int, chunk_level string, parent_chunk_id string, section_title string, page_start int, page_end int, token_count int, text string, metadata string",
    "embeddings": "chunk_id string, model string, dimension int, embedding array<float>",
    "ingestion_jobs": "job_id long, document_id long, job_type string, status string, retries int, max_retries int, payload string, created_at timestamp, available_at timestamp, locked_by string, locked_at timestamp",
    "retrieval_cache": "cache_key string, chunk_ids array<string>, expires_at timestamp",
    "rerank_cache": "query_hash string, chunk_id string, model string, score double",
    "answer_cache": "cache_key string, question string, prompt string, answer string, sources array<string>, chunk_ids array<string>, used_model boolean, backend string, expires_at timestamp",
    "threads": "thread_id string, user_id string, title string, intent string, updated_at timestamp",
    "memories": "memory_id string, user_id string, content string, importance double, created_at timestamp",
    "reviews": "review_id long, fact_id long, reviewer string, comment string, status string, created_at timestamp",
    "query_log": "query_text string, retrieved_chunk_ids array<string>, answer_text string, used_model boolean, prompt string, source_count int, created_at timestamp",
}


def bootstrap(spark: SparkSession, folder: str) -> dict[str, str]:
    """Make the tables that a folder lacks, empty; those that are there stay. Gives each table's path."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in TABLES}


def widened(df: DataFrame, schema: str, **defaults: object) -> DataFrame:
    """Rows with all columns of a schema, and then their own others; a column that they lack has its default, or null."""
    wanted = StructType.fromDDL(schema)
    have = set(df.columns)
    new = [(F.col(c.name) if c.name in have else F.lit(defaults.get(c.name))).cast(c.dataType).alias(c.name) for c in wanted]
    return df.select(*new, *(c for c in df.columns if c not in set(wanted.names)))


def opened(spark: SparkSession, folder: str, name: str, **defaults: object) -> DataFrame:
    """A table as it is now meant to be, also where its files have fewer columns."""
    return widened(spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}"), TABLES[name], **defaults)
