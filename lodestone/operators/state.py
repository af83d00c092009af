"""Mutable tables as keyed merges: caches, jobs, threads, memories, logs and reviews.

Every function takes the present rows and gives the next generation; times are explicit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key: new ones replace existing ones."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def added(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key: existing ones stay, new ones of an existing key are ignored."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def expires(written_at: Column, days: int) -> Column:
    """When an entry expires; never if ``days`` isn't positive."""
    return written_at + F.make_dt_interval(F.lit(days)) if days > 0 else F.lit(None).cast("timestamp")


def fresh(as_of: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > as_of)


def cache_lookup(cache: DataFrame, chunks: DataFrame, as_of: Column) -> DataFrame:
    """Cached id lists (cache_key, chunk_ids, expires_at) as rows in their order; a missing chunk makes the entry a miss."""
    rows = cache.where(fresh(as_of)).select("cache_key", F.size("chunk_ids").alias("n"), F.posexplode("chunk_ids").alias("place", "chunk_id"))
    found = rows.join(chunks, "chunk_id")
    return found.withColumn("known", F.count("*").over(Window.partitionBy("cache_key"))).where("known = n").select("cache_key", (F.col("place") + 1).alias("rank"), "chunk_id")


def threads(turns: DataFrame) -> DataFrame:
    """Threads of turns (thread_id, turn, role, text): turn_count, title (the first user text) and roles in order."""
    return turns.groupBy("thread_id").agg(F.count("*").alias("turn_count"), F.min_by(F.substring("text", 1, 60), F.when(F.col("role") == "user", F.col("turn"))).alias("title"), F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("history"))


def remembered(turns: DataFrame, importance: float = 0.4, most: int = 3, longer_than: int = 40) -> DataFrame:
    """The first long lines of each thread as memories: thread_id, nth, content, importance."""
    lines = turns.select("thread_id", "turn", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("line", F.btrim("line")).where(F.char_length("line") > longer_than)
    order = Window.partitionBy("thread_id").orderBy("turn", "place")
    return lines.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("thread_id", "nth", F.col("line").alias("content"), F.lit(importance).alias("importance"))


JOB = "job_id long, document_id long, job_type string, status string, retries int, max_retries int, payload string, created_at timestamp, available_at timestamp"


def enqueued(jobs: DataFrame, new: DataFrame, as_of: Column, max_retries: int = 3) -> DataFrame:
    """Jobs (JOB) with new ones (job_id, document_id, job_type, payload): queued, due at once. A known job_id stays as it is."""
    rows = new.select("job_id", "document_id", "job_type", F.lit("queued").alias("status"), F.lit(0).alias("retries"), F.lit(max_retries).alias("max_retries"), "payload", as_of.alias("created_at"), as_of.alias("available_at"))
    return added(jobs, rows, ["job_id"])


def listed(jobs: DataFrame, status: str | None = None, most: int = 50) -> DataFrame:
    """The newest jobs, of one status if one is given."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "job_id").limit(most)


def invalidated(cache: DataFrame, keys: DataFrame, by: str = "cache_key") -> DataFrame:
    """A cache without the entries of some keys; a null key is none."""
    return cache.join(keys.select(by).distinct(), by, "left_anti")


def unexpired(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(fresh(as_of))


def claimable(jobs: DataFrame, as_of: Column, slots: int = 1, *by: str) -> DataFrame:
    """The oldest due jobs that are queued or to be retried: up to ``slots`` of each group."""
    due = jobs.where(F.col("status").isin("queued", "retry") & (F.col("available_at") <= as_of))
    order = Window.partitionBy(*by).orderBy("created_at", "job_id")
    return due.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= slots)


def claimed(jobs: DataFrame, chosen: DataFrame, worker: str, as_of: Column) -> DataFrame:
    """Jobs after a worker took the chosen ones; one writer makes each generation, so none is taken twice."""
    mark = chosen.select("job_id", F.lit(True).alias("taken"))
    rows = jobs.join(mark, "job_id", "left")
    taken = F.col("taken").isNotNull()
    return rows.withColumn("status", F.when(taken, "running").otherwise(F.col("status"))).withColumn("locked_by", F.when(taken, F.lit(worker))).withColumn("locked_at", F.when(taken, as_of)).drop("taken")


def backoff_seconds(retries: Column) -> Column:
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), retries)).cast("int")


def after_failure(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Failed jobs wait and are retried, until their retries are used up."""
    again = F.col("retries") + 1 <= F.col("max_retries")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(F.col("retries") + 1).cast("decimal(18,6)"))
    return jobs.withColumn("available_at", F.when(again, as_of + wait).otherwise(F.col("available_at"))).withColumn("status", F.when(again, "retry").otherwise("failed")).withColumn("retries", F.col("retries") + 1)


def request_metrics(log: DataFrame, as_of: Column) -> DataFrame:
    """Of the last 24 hours of a request log (created_at, status_code, latency_ms): counts, mean and 95th percentile."""
    day = log.where(F.col("created_at") >= as_of - F.expr("INTERVAL 24 HOURS"))
    return day.agg(F.count("*").alias("request_count"), F.count_if(F.col("status_code") >= 500).alias("error_count"), F.round(F.avg("latency_ms"), 2).alias("avg_latency"), F.percentile("latency_ms", F.lit(0.95)).alias("p95_latency"))


def recent_in_window(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests (client, at) with the number of the client's requests in the window up to each."""
    over = Window.partitionBy("client").orderBy(F.unix_micros(F.col("at").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("in_window", F.count("*").over(over))


def rate_limited(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Requests (client, seq, at) with ``rejected``: a client has ``limit`` accepted ones in the window; rejected ones don't count.

    A client's requests come to one task in the order of time, and stream through it: it holds the
    accepted ones of one window, ``limit`` at most, however many requests there are.
    """
    schema = f"client {dict(requests.dtypes)['client']}, seq long, rejected boolean"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, accepted = None, deque()
        for rows in batches:
            out = []
            for name, at in zip(rows["client"], rows["at"], strict=True):
                if name != client:
                    client, accepted = name, deque()
                while accepted and (at - accepted[0]).total_seconds() > seconds:
                    accepted.popleft()
                full = len(accepted) >= limit
                if not full:
                    accepted.append(at)
                out.append(full)
            yield pd.DataFrame({"client": rows["client"], "seq": rows["seq"], "rejected": out})

    ordered = requests.select("client", "seq", "at").where("client is not null").repartition("client").sortWithinPartitions("client", "at", "seq")
    return ordered.mapInPandas(judge, schema)


def tolerant_insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended by the columns that the table has; columns that rows lack are null."""
    have = set(rows.columns)
    known = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in table.dtypes]
    return table.unionByName(rows.select(*known))


def reviewed(reviews: DataFrame, facts: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews with new statuses, and facts that follow their review's status."""
    new = updates.select("review_id", F.col("status").alias("new_status"))
    after = reviews.join(new, "review_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    followed = facts.join(after.select("fact_id", F.col("status").alias("review_status")), "fact_id", "left").withColumn("status", F.coalesce("review_status", "status")).drop("review_status")
    return after, followed


def review_created(reviews: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Reviews with new ones (review_id, fact_id, reviewer, comment), pending; a known review_id stays as it is."""
    rows = new.select("review_id", "fact_id", "reviewer", "comment", F.lit("pending").alias("status"), as_of.alias("created_at"))
    return added(reviews, rows, ["review_id"])


def pending_reviews(reviews: DataFrame) -> DataFrame:
    """How many reviews wait, as the operations' metrics have it."""
    return reviews.agg(F.count_if(F.col("status") == "pending").alias("pending_reviews"))


def run_jobs(jobs: DataFrame, handlers: dict[str, Callable[[dict], dict]], as_of: datetime) -> list[dict]:
    """Run claimed jobs on the driver, one by one, by their type; each is a whole Spark job of its own.

    The claimed jobs are few by construction (``claimable``'s slots).
    """
    out = []
    for job in jobs.toLocalIterator():
        try:
            result = handlers[job["job_type"]](job.asDict())
            out.append({"job_id": job["job_id"], "status": "succeeded", "finished_at": as_of, "result": str(result)})
        except Exception as error:  # a failed job is retried, it doesn't end the worker
            out.append({"job_id": job["job_id"], "status": "failed", "finished_at": as_of, "result": str(error)})
    return out
