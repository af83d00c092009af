"""Embeddings: literals, missing ones, recall and semantic lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import text as T


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector: Column, places: int) -> Column:
    """A vector as text; each component's exact value is rounded, halves to even, as C does and Java's formatter doesn't."""

    @F.arrow_udf("string")
    def shown(vectors: pa.Array) -> pa.Array:
        form = f"%.{places}f"
        return pa.array([None if v is None else "[" + ",".join(form % x for x in v if x is not None) + "]" for v in vectors.to_pylist()], pa.string())

    return shown(vector.cast("array<double>"))


def to_embed(docs: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Documents that a model hasn't embedded, with the text that it is given."""
    title = F.concat_ws(" ", "source", "lang", F.lit("report"))
    text = F.concat(title, F.lit("\n"), F.substring(T.squeeze(F.col("text")), 1, 1800))
    rows = docs.where("coalesce(text, '') <> ''").join(done.where(F.col("model") == model).select("doc_id"), "doc_id", "left_anti")
    return rows.select("doc_id", text.alias("embed_text"))


def hash_model(dimension: int) -> Callable[[pd.Series], list[np.ndarray]]:
    """A stand-in for a model: unit vectors from the repeated SHA-256 of the text. Any function of a batch of texts will do."""
    import hashlib

    def embed(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for text in texts:
            data = np.resize(np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8), dimension) / 255.0 * 2 - 1
            out.append((data / np.linalg.norm(data)).astype(np.float32))
        return out

    return embed


def embed(rows: DataFrame, model: Callable[[pd.Series], list[np.ndarray]], dimension: int) -> DataFrame:
    """Embeddings of ``embed_text`` in Arrow batches; the model is set up once in a worker. Wrong dimensions are dropped."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model(texts))

    return rows.withColumn("embedding", run("embed_text")).where(F.size("embedding") == dimension).drop("embed_text")


def embedded_questions(questions: DataFrame, model: Callable[[pd.Series], list[np.ndarray]], name: str, dimension: int, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (q_id, question) with their embedding, and the next generation of the cache (query_hash, model, embedding).

    The model sees each different question that the cache lacks once; wrong dimensions are dropped.
    """
    asked = questions.withColumn("query_hash", Q.query_hash(F.col("question")))
    known = cache.where(F.col("model") == name).select("query_hash", "embedding")
    missing = asked.join(known.select("query_hash"), "query_hash", "left_anti").groupBy("query_hash").agg(F.min("question").alias("embed_text"))
    new = embed(missing, model, dimension)
    both = known.unionByName(new.select("query_hash", "embedding"))
    after = cache.unionByName(new.select("query_hash", F.lit(name).alias("model"), "embedding"))
    return asked.join(both, "query_hash").select("q_id", "question", "embedding"), after


#: Rows and queries that a task compares at once, and queries that are sent to all tasks.
BLOCK_ROWS, BLOCK_QUERIES, MOST_QUERIES = 4_096, 256, 20_000
#: Matches that a task holds before it drops those that others of it beat, and rows of a batch that it gives.
MOST_HELD, BLOCK_OUT = 200_000, 50_000


def _usable(name: str, vector: str) -> Column:
    """Rows with a name, and a vector of finite components that isn't all zero."""
    return F.col(name).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def best_matches(rows: DataFrame, asked: DataFrame, k: int, least: float = -1.0, buckets: tuple[float, int] | None = None) -> DataFrame:
    """The k rows (id, weight, embedding) of the highest weight times cosine similarity for each query (q_id, embedding).

    Columns: q_id, id, similarity, value (both of 9 decimals), rank; ties go to the smaller id. Only
    similarities of at least ``least`` count. ``asked`` is a stated set: each task gives its own k best
    of every query, and these are merged; MOST_QUERIES queries are sent at once. Vectors
    that are null, hold null or non-finite components, are all zero or have another dimension take no part.
    With ``buckets`` (width, tables) only pairs that share a bucket of a random projection in a table
    count, and value is their unit vectors' distance (6 decimals), below zero.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    plain = rows.where(_usable("id", "embedding")).select("id", F.col("weight").cast("double").alias("weight"), F.col("embedding").cast("array<double>").alias("embedding"))
    told = asked.where(_usable("q_id", "embedding")).select("q_id", F.col("embedding").cast("array<double>").alias("embedding"))
    shares = max(1, -(-told.count() // MOST_QUERIES))
    found = None
    for share in range(shares):
        table = told.where(F.pmod(F.xxhash64("q_id"), F.lit(shares)) == share).toArrow().sort_by("q_id")
        sent = spark.sparkContext.broadcast((table.column("q_id").to_pylist(), table.column("embedding").to_pylist()))
        part = plain.mapInArrow(_block_best(sent, k, least, buckets), f"q_id {dict(asked.dtypes)['q_id']}, id {kinds['id']}, similarity double, value double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("q_id").orderBy(F.desc("value"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _hashed(unit: np.ndarray, width: float, tables: int) -> np.ndarray:
    """The bucket of each unit vector in each table: its place on a random direction, in steps of ``width``."""
    directions = np.random.default_rng(42).standard_normal((tables, unit.shape[1]))
    directions /= np.sqrt((directions * directions).sum(axis=1))[:, None]
    return np.floor(unit @ directions.T / width).astype(np.int64)


def _block_best(sent, k: int, least: float, buckets: tuple[float, int] | None = None):
    """A function of batches (id, weight, embedding) that gives each query's k best rows of its task."""

    def run(batches):
        names, asked = sent.value
        of_size: dict[int, list[int]] = {}
        for at, vector in enumerate(asked):
            of_size.setdefault(len(vector), []).append(at)
        unit = {size: (m := np.array([asked[at] for at in at_rows]), np.sqrt((m * m).sum(axis=1))) for size, at_rows in of_size.items()}
        hashes = {size: _hashed(m / norm[:, None], *buckets) for size, (m, norm) in unit.items()} if buckets else {}
        held: list[list[np.ndarray]] = []
        n_held = 0

        def cut():
            nonlocal held, n_held
            q, value, ids, similarity = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((ids, -value, q))
            ordered = q[order]
            begins = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1))
            nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            held = [[x[order[nth < k]] for x in (q, value, ids, similarity)]]
            n_held = len(held[0][0])

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(start, BLOCK_ROWS)
                ids, weight, vectors = block.column(0).to_pylist(), block.column(1).to_numpy(zero_copy_only=False), block.column(2)
                length = np.diff(vectors.offsets.to_numpy())
                by_id = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
                name = np.array(ids)
                for size in np.unique(length).tolist():
                    if size not in unit:
                        continue
                    own = by_id[length[by_id] == size]
                    values = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    norm = np.sqrt((values * values).sum(axis=1))
                    mine = _hashed(values / norm[:, None], *buckets) if buckets else None
                    for first in range(0, len(of_size[size]), BLOCK_QUERIES):
                        w, w_norm = (x[first : first + BLOCK_QUERIES] for x in unit[size])
                        similarity = w @ values.T / (w_norm[:, None] * norm)
                        if buckets:
                            theirs = hashes[size][first : first + BLOCK_QUERIES]
                            meets = np.zeros(similarity.shape, bool)
                            for table in range(mine.shape[1]):
                                meets |= theirs[:, table, None] == mine[:, table]
                            value = np.where(meets, -np.round(np.sqrt(np.maximum(0.0, 2 - 2 * similarity)), 6) + 0.0, -np.inf)
                            similarity = np.round(similarity, 9) + 0.0
                        else:
                            similarity = np.round(similarity, 9) + 0.0
                            value = np.where(similarity >= least, np.round(weight[own] * similarity, 9) + 0.0, -np.inf)
                        order = np.argsort(-value, axis=1, kind="stable")[:, :k]
                        row, place = np.nonzero(np.take_along_axis(value, order, axis=1) > -np.inf)
                        at = order[row, place]
                        if len(at):
                            held.append([np.array(of_size[size])[first + row], value[row, at], name[own[at]], similarity[row, at]])
                            n_held += len(at)
                            if n_held > max(MOST_HELD, 2 * len(names) * k):
                                cut()
        if held:
            cut()
            q, value, ids, similarity = held[0]
            for start in range(0, len(q), BLOCK_OUT):
                at = slice(start, start + BLOCK_OUT)
                yield pa.RecordBatch.from_pydict({"q_id": [names[x] for x in q[at]], "id": ids[at].tolist(), "similarity": similarity[at], "value": value[at]})

    return run


def recalled(memories: DataFrame, asked: DataFrame, k: int = 4, least: float = 0.60) -> DataFrame:
    """The k memories of the highest importance times similarity, from a least similarity on."""
    rows = best_matches(memories.select(F.col("memory_id").alias("id"), F.col("importance").alias("weight"), "embedding"), asked, k, least)
    return rows.select("q_id", F.col("id").alias("memory_id"), F.round("similarity", 6).alias("similarity"), "rank")


def semantic_hits(cache: DataFrame, asked: DataFrame, as_of: Column, least: float = 0.95) -> DataFrame:
    """Each query's nearest unexpired entry, and whether it is near enough."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    best = best_matches(live.select(F.col("entry_id").alias("id"), F.lit(1.0).alias("weight"), "embedding"), asked, 1)
    similarity = F.col("similarity")
    return best.select("q_id", F.when(similarity >= least, F.col("id")).alias("entry_id"), F.round(similarity, 6).alias("similarity"), (similarity >= least).alias("hit"))


def embedding_coverage(chunks: DataFrame, done: DataFrame, *by: str) -> DataFrame:
    marked = chunks.join(done.select("doc_id").distinct().withColumn("done__", F.lit(True)), "doc_id", "left")
    return marked.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("done__").isNotNull()).alias("done"), F.round(F.count_if(F.col("done__").isNotNull()) / F.count("*"), 4).alias("share"))


def progress(done: DataFrame) -> DataFrame:
    """Finished embeddings by hour, in all so far, and the change from the hour before; hours are few."""
    hours = done.groupBy(F.date_trunc("hour", "done_at").alias("hour")).agg(F.count("*").alias("n"))
    order = Window.orderBy("hour")
    return hours.select("hour", "n", F.sum("n").over(order).alias("total"), (F.col("n") - F.lag("n").over(order)).alias("change"))


def approximate_nearest(vectors: DataFrame, every: int, k: int, width: float = 1.2, tables: int = 8) -> DataFrame:
    """The k nearest by random projections of unit vectors; rows whose id is divisible by ``every`` ask.

    Every row is hashed where it is read; a query's candidates are the rows that share a bucket with it
    in some table, and no pair of candidates is shuffled that another of its task beats. Euclidean
    distance of unit vectors orders as cosine does.
    """
    rows = vectors.select(F.col("vec_id").alias("id"), F.lit(1.0).alias("weight"), "embedding")
    asked = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q_id"), "embedding")
    near = best_matches(rows, asked, k + 1, buckets=(width, tables)).where("q_id <> id")
    order = Window.partitionBy("q_id").orderBy("distance", "id")
    near = near.select("q_id", "id", (-F.col("value") + 0.0).alias("distance")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.select(F.col("q_id").alias("query_id"), F.col("id").alias("vec_id"), "distance", "rank")
