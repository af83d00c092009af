"""Queries of vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import vectors as O
from lodestone.operators.retrieval import nearest
from lodestone.plans.base import questions, read
from lodestone.sources import shared


def hash_embedding(spark, sf_dir):
    v = F.col("v")
    rows = read(spark, sf_dir, "documents").select("doc_id", T.hash_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size(v).alias("dimension"), F.round(v[0], 6).alias("first"), F.round(v[1023], 6).alias("last"), (F.round(F.aggregate(F.slice(v, 1, 32), F.lit(0.0), lambda s, x: s + x), 4) + 0.0).alias("sum_of_cycle"))


def literals(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", O.literal(F.col("embedding"), 6).alias("literal"))


def missing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    done = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("hash-1024").alias("model"))
    return O.to_embed(docs, done, "hash-1024").select("doc_id", F.md5("embed_text").alias("digest"))


def embedded(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    none = docs.limit(0).select("doc_id", F.lit("").alias("model"))
    rows = O.embed(O.to_embed(docs, none, "hash-64"), O.hash_model(64), 64)
    return rows.select("doc_id", F.size("embedding").alias("dimension"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(F.element_at("embedding", 64).cast("double"), 6).alias("last"))


def question_embeddings(spark, sf_dir):
    """Questions of odd numbers are in the cache already."""
    asked = questions(spark, sf_dir)
    none = asked.limit(0).select(F.lit("").alias("query_hash"), F.lit("").alias("model"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    _, cache = O.embedded_questions(asked.where("q_id % 2 = 1"), O.hash_model(64), "hash-64", 64, none)
    rows, after = O.embedded_questions(asked, O.hash_model(64), "hash-64", 64, shared.kept(cache))
    n = after.agg(F.count("*").alias("n_cached"))
    return rows.crossJoin(n).select("q_id", "n_cached", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def memory_recall(spark, sf_dir):
    """Every vector is a memory, with its label as its importance, and those divisible by 50 are asked."""
    vectors = read(spark, sf_dir, "embeddings")
    memories = vectors.select(F.col("vec_id").alias("memory_id"), "embedding", ((F.col("label") % 10 + 1) / 10.0).alias("importance"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    return O.recalled(memories, asked, k=4, least=0.20)


def semantic_cache(spark, sf_dir):
    """Even vectors are cached queries, those divisible by 50 are asked."""
    vectors = read(spark, sf_dir, "embeddings")
    cache = vectors.where("vec_id % 2 = 1").select(F.col("vec_id").alias("entry_id"), "embedding", F.lit(None).cast("timestamp").alias("expires_at"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    return O.semantic_hits(cache, asked, F.to_timestamp(F.lit("2024-01-01")), least=0.40)


def coverage(spark, sf_dir):
    docs, vectors = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return O.embedding_coverage(docs.select("doc_id", "lang"), vectors, "lang")


def progress(spark, sf_dir):
    """Events are finished embeddings; the rate is the number of an hour less that of the hour before."""
    return O.progress(read(spark, sf_dir, "events").select(F.col("ts").alias("done_at")))


def nearest_lsh(spark, sf_dir):
    """Whether nine of ten of the exactly nearest vectors are found."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = O.approximate_nearest(vectors, every=50, k=5).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    near = nearest(vectors.select(F.format_string("%020d", "vec_id").alias("chunk_id"), "embedding"), asked, 6)
    true = near.select(F.col("q_id").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"), "rank").where("query_id <> vec_id")
    true = true.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("nth <= 5")
    return true.join(found, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_enough"))


_COS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v),
p AS (SELECT q.vec_id AS q_id, c.vec_id, c.label, round(list_sum(list_transform(list_zip(c.v, q.v), lambda z: z[1] * z[2])) / (c.size * q.size), 9) AS similarity FROM s q JOIN s c ON q.vec_id % 50 = 0 AND q.size > 0 AND c.size > 0)"""

_HASHED = "list_transform(range(0, 64), lambda i: ((strpos('0123456789abcdef', substring(sha256({0}), (i % 32) * 2 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substring(sha256({0}), (i % 32) * 2 + 2, 1)) - 1) / 255e0 * 2 - 1)"
_UNIT = "round(CAST(CAST(v[{0}] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS FLOAT) AS DOUBLE), 6)"

QUERIES = {
    "v01_hash_embedding": (
        hash_embedding,
        """WITH h AS (SELECT doc_id, list_transform(range(0, 1024), lambda i: ((strpos('0123456789abcdef', substring(d, (i % 32) * 2 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substring(d, (i % 32) * 2 + 2, 1)) - 1) / 255e0 * 2 - 1) AS v FROM (SELECT doc_id, sha256(text) AS d FROM documents))
        SELECT doc_id, CAST(len(v) AS INTEGER) AS dimension, round(v[1], 6) AS first, round(v[1024], 6) AS last, round(list_sum(v[1:32]), 4) + 0e0 AS sum_of_cycle FROM h""",
    ),
    "v02_vector_literal": (literals, "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']' AS literal FROM embeddings"),
    "v03_missing_embeddings": (
        missing,
        r"SELECT doc_id, md5(concat_ws(' ', source, lang, 'report') || chr(10) || substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1800)) AS digest FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND coalesce(text, '') <> ''",
    ),
    "v03_embedded": (
        embedded,
        rf"""SELECT doc_id, 64 AS dimension, {_UNIT.format(1)} AS first, {_UNIT.format(64)} AS last FROM (SELECT doc_id, {_HASHED.format(r"concat_ws(' ', source, lang, 'report') || chr(10) || substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1800)")} AS v FROM documents WHERE coalesce(text, '') <> '')""",
    ),
    "v04_question_embeddings": (
        question_embeddings,
        f"SELECT q_id, (SELECT count(DISTINCT lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) FROM benchmark) AS n_cached, {_UNIT.format(1)} AS first FROM (SELECT item_id AS q_id, {_HASHED.format('text')} AS v FROM benchmark)",
    ),
    "v05_memory_recall": (
        memory_recall,
        f"""WITH {_COS}, k AS (SELECT q_id, vec_id AS memory_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round((label % 10 + 1) / 10e0 * similarity, 9) DESC, vec_id) AS INTEGER) AS rank FROM p WHERE similarity >= 0.20)
        SELECT * FROM k WHERE rank <= 4""",
    ),
    "v06_semantic_cache": (
        semantic_cache,
        f"""WITH {_COS}, b AS (SELECT q_id, vec_id AS entry_id, similarity, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) AS nth FROM p WHERE vec_id % 2 = 1)
        SELECT q_id, CASE WHEN similarity >= 0.40 THEN entry_id END AS entry_id, round(similarity, 6) AS similarity, similarity >= 0.40 AS hit FROM b WHERE nth = 1""",
    ),
    "v07_coverage": (coverage, "SELECT lang, count(*) AS total, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS done, round(count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) / CAST(count(*) AS DOUBLE), 4) AS share FROM documents GROUP BY lang"),
    "v07_progress": (
        progress,
        "SELECT hour, n, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) AS total, n - lag(n) OVER (ORDER BY hour) AS change FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1)",
    ),
    "r12_nearest_lsh": (nearest_lsh, "SELECT count(*) AS queries, TRUE AS recall_enough FROM embeddings WHERE vec_id % 50 = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0"),
}
