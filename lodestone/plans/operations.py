"""Queries of caches, jobs, threads, logs and reviews, over the driver's tables as stand-ins."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.operators import state as O
from lodestone.plans import sql as S
from lodestone.plans.base import indexed_chunks, questions, read, vector_hits


def _at(text):
    return F.to_timestamp(F.lit(text))


def _jobs(spark, sf_dir):
    """Orders are jobs: open ones queued, pending ones to be retried, finished ones done."""
    rows = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "retry").otherwise("succeeded")
    return rows.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_type"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("available_at"), (F.col("o_orderkey") % 5).cast("int").alias("retries"), F.lit(3).alias("max_retries"))


def _requests(spark, sf_dir):
    """Events are requests: errors fail, values are latencies."""
    rows = read(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    return rows.select(F.col("event_id").alias("request_id"), code.alias("status_code"), F.col("value").alias("latency_ms"), F.col("user_id").alias("client"), F.col("ts").alias("created_at"))


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", "text")


def corpus_fingerprint(spark, sf_dir):
    row = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.max("doc_id").alias("a"), F.max("n_chars").alias("b"), F.max("source").alias("c"))
    return row.select(F.sha2(F.concat_ws("|", "n", "a", "b", "c"), 256).alias("fingerprint"))


def strategy_fingerprints(spark, sf_dir):
    rows = spark.range(1).select(*(c.fingerprint().alias(name) for name, c in R.STRATEGIES.items()))
    return rows.select(F.explode(F.create_map(*(x for name in R.STRATEGIES for x in (F.lit(name), F.col(name))))).alias("strategy", "fingerprint"))


def retrieval_cache(spark, sf_dir):
    """Cached hits of all questions; entries that hold a chunk number of no document miss."""
    hits = vector_hits(spark, sf_dir, 6)
    cache = hits.groupBy(F.col("q_id").alias("cache_key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    cache = cache.withColumn("chunk_ids", F.when(F.col("cache_key") % 7 == 0, F.concat("chunk_ids", F.array(F.lit("none")))).otherwise(F.col("chunk_ids"))).withColumn("expires_at", F.when(F.col("cache_key") % 5 == 0, _at("2023-12-31")))
    return O.cache_lookup(cache, indexed_chunks(spark, sf_dir).select("chunk_id"), _at("2024-01-01"))


def answer_cache(spark, sf_dir):
    """Answers by question and corpus; entries of an hour before as of are still fresh for seven days."""
    asked = questions(spark, sf_dir).select(Q.query_hash(F.col("question")).alias("cache_key"), "q_id", _at("2024-01-01").alias("written_at"))
    old = asked.where("q_id % 2 = 0").withColumn("written_at", _at("2023-01-01"))
    rows = O.upserted(old, asked.where("q_id % 3 = 0"), ["cache_key"]).withColumn("expires_at", O.expires(F.col("written_at"), 7))
    return rows.select("q_id", O.fresh(_at("2024-01-02")).alias("fresh"))


def rerank_cache(spark, sf_dir):
    """Pairs that lack a cached score: of every fourth vector's chunk."""
    pairs = vector_hits(spark, sf_dir, 30).select("q_id", "chunk_id")
    known = pairs.where(F.regexp_extract("chunk_id", r"^(\d+)-", 1).cast("long") % 4 != 0)
    return pairs.join(known, ["q_id", "chunk_id"], "left_anti").groupBy("q_id").agg(F.count("*").alias("misses"))


def semantic_cache_set(spark, sf_dir):
    """User texts of at least ten characters are cached once; assistants' later texts don't replace them."""
    turns = _turns(spark, sf_dir).where(F.char_length("text") >= 10)
    first = turns.where("role = 'user'").groupBy("text").agg(F.min("thread_id").alias("thread_id"))
    rows = O.added(first, turns.where("role <> 'user'").groupBy("text").agg(F.min("thread_id").alias("thread_id")), ["text"])
    return rows.agg(F.count("*").alias("entries"), F.sum(F.char_length("text").cast("long")).alias("chars"), F.max("thread_id").alias("newest"))


def semantic_cache_invalidated(spark, sf_dir):
    """Entries expire a day after their order; those of a customer are taken out."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cache_key"), F.col("o_custkey").alias("owner"), O.expires(F.col("o_orderdate").cast("timestamp"), 1).alias("expires_at"))
    gone = rows.where("owner % 10 = 3").select("cache_key")
    left = O.unexpired(O.invalidated(rows, gone), _at("1995-01-01"))
    return left.agg(F.count("*").alias("entries"), F.min("cache_key").alias("least"), F.sum("owner").alias("owners"))


def enqueued_jobs(spark, sf_dir):
    """Orders of even keys are jobs; all orders are enqueued."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("job_type"), F.lit("{}").alias("payload"))
    jobs = O.enqueued(spark.createDataFrame([], O.JOB), rows.where("job_id % 2 = 0"), _at("1998-01-01"))
    after = O.enqueued(jobs.withColumn("status", F.lit("succeeded")), rows, _at("1998-01-02"))
    return O.listed(after, "queued").select("job_id", "document_id", "job_type", "status", "retries", "max_retries", "created_at")


def threads(spark, sf_dir):
    rows = O.threads(_turns(spark, sf_dir))
    return rows.select("thread_id", "turn_count", "title", F.array_join("history", ",").alias("history"))


def memories(spark, sf_dir):
    return O.remembered(_turns(spark, sf_dir)).select("thread_id", "nth", F.md5("content").alias("digest"), "importance")


def job_list(spark, sf_dir):
    return _jobs(spark, sf_dir).where("status = 'queued'").orderBy(F.desc("created_at"), "job_id").limit(50).select("job_id", "job_type", "created_at")


def claim_next(spark, sf_dir):
    jobs, now = _jobs(spark, sf_dir), _at("1998-01-01")
    after = O.claimed(jobs, O.claimable(jobs, now, 3, "job_type"), "worker-1", now)
    return after.where("status = 'running'").select("job_id", "job_type", "locked_by", "locked_at")


def backoff(spark, sf_dir):
    now = _at("1998-01-01")
    rows = O.after_failure(_jobs(spark, sf_dir), now)
    return rows.select("job_id", "status", "retries", "available_at")


def dispatch(spark, sf_dir):
    """The oldest job of each type is run on the driver; its handler counts the jobs of the type."""
    jobs = _jobs(spark, sf_dir)
    counts = {r["job_type"]: r["count"] for r in jobs.groupBy("job_type").count().collect()}
    chosen = O.claimable(jobs, _at("1999-01-01"), 1, "job_type")
    done = O.run_jobs(chosen, dict.fromkeys(counts, lambda job: counts[job["job_type"]]), None)
    return spark.createDataFrame([(d["job_id"], d["status"], d["result"]) for d in done], "job_id long, status string, result string")


def request_metrics(spark, sf_dir):
    log = _requests(spark, sf_dir)
    return O.request_metrics(log, _at("2024-01-30 12:00:00"))


def recent_errors(spark, sf_dir):
    return _requests(spark, sf_dir).where("status_code >= 400").orderBy(F.desc("created_at"), "request_id").limit(10).select("request_id", "status_code", "created_at")


def reviews(spark, sf_dir):
    """Labels are reviews of documents as facts; those of quality 0 are rejected, and their facts follow."""
    labels = read(spark, sf_dir, "labels")
    pending = labels.select(F.col("doc_id").alias("review_id"), F.col("doc_id").alias("fact_id"), F.lit("pending").alias("status"))
    facts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.lit("pending").alias("status"))
    updates = labels.select(F.col("doc_id").alias("review_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("status"))
    return O.reviewed(pending, facts, updates)[1].groupBy("status").agg(F.count("*").alias("n"))


def _reviews(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), F.col("doc_id").alias("fact_id"), F.concat(F.lit("user"), (F.col("doc_id") % 3).cast("string")).alias("reviewer"), F.lit("").alias("comment"), "quality")
    old = O.review_created(spark.createDataFrame([], "review_id long, fact_id long, reviewer string, comment string, status string, created_at timestamp"), labels.where("quality = 1"), _at("2024-01-01"))
    return O.review_created(old.withColumn("status", F.lit("approved")), labels, _at("2024-01-02"))


def created_reviews(spark, sf_dir):
    """Reviews of good documents were made and approved before all are made."""
    return _reviews(spark, sf_dir).groupBy("status", "reviewer", "created_at").agg(F.count("*").alias("n"))


def pending_reviews(spark, sf_dir):
    return O.pending_reviews(_reviews(spark, sf_dir))


def request_log_dedupe(spark, sf_dir):
    """Requests are logged twice, those of even numbers before: a known request_id is no new row, and the first of two counts."""
    rows = _requests(spark, sf_dir).select("request_id", "status_code", "client", "created_at")
    old = rows.where("request_id % 2 = 0").withColumn("status_code", F.lit(0))
    return O.added(old, rows.unionByName(rows), ["request_id"]).select("request_id", "status_code", "client")


def requests_in_window(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("client", "request_id", F.col("created_at").alias("at"))
    return O.recent_in_window(rows, 3600).select("request_id", "in_window")


def rate_limited(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("client", F.col("request_id").alias("seq"), F.col("created_at").alias("at"))
    return O.rate_limited(rows, 2, 24 * 3600)


def tolerant_insert(spark, sf_dir):
    table = read(spark, sf_dir, "supplier")
    rows = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), "s_name", F.lit(1).alias("unknown_column"))
    return O.tolerant_insert(table, rows)


def thread_list(spark, sf_dir):
    return O.threads(_turns(spark, sf_dir)).orderBy(F.desc("turn_count"), "thread_id").limit(20).select("thread_id", "turn_count", "title")


def health(spark, sf_dir):
    """Rows and latest change of the tables that must answer."""
    parts = [read(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows", (F.col("rows") > 0).alias("healthy")) for t in ("documents", "embeddings", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def excerpts(spark, sf_dir):
    """A text around the first place of the question's longest words."""
    hits = vector_hits(spark, sf_dir, 3).join(questions(spark, sf_dir), "q_id")
    text = T.squeeze(F.col("text"))
    terms = F.filter(T.words(F.col("question")), lambda w: F.char_length(w) > 2)
    places = F.filter(F.transform(terms, lambda w: F.position(F.lower(w), F.lower(text)) - 1), lambda p: p >= 0)
    start = F.coalesce(F.greatest(F.lit(0), F.array_min(places) - 90), F.lit(0))
    shown = F.concat(F.when(start > 0, "... ").otherwise(""), F.substring(text, start + 1, F.lit(760)), F.when(start + 760 < F.char_length(text), " ...").otherwise(""))
    return hits.select("q_id", "rank", F.md5(shown).alias("digest"))


def slash_commands(spark, sf_dir):
    """What /memories shows: the ten newest."""
    return O.remembered(_turns(spark, sf_dir)).orderBy(F.desc("thread_id"), F.desc("nth")).limit(10).select("thread_id", "nth", "importance")


def valid_requests(spark, sf_dir):
    """Requests within the limits: questions of 1 to 2000 characters, 1 to 20 hits."""
    rows = _turns(spark, sf_dir).where("role = 'user'").withColumn("top_k", (F.col("thread_id") % 25).cast("int"))
    ok = F.char_length("text").between(1, 2000) & F.col("top_k").between(1, 20)
    return rows.groupBy(ok.alias("valid")).agg(F.count("*").alias("n"))


_JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS job_type, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'retry' ELSE 'succeeded' END AS status, o_orderdate AS created_at, CAST(o_orderkey % 5 AS INTEGER) AS retries FROM orders)"
_REQ = "req AS (SELECT event_id AS request_id, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status_code, value AS latency_ms, user_id AS client, ts AS created_at FROM events)"
_THREADS = "SELECT conv_id AS thread_id, count(*) AS turn_count, arg_min(substring(text, 1, 60), CASE WHEN role = 'user' THEN turn END) AS title, string_agg(role, ',' ORDER BY turn, role) AS history FROM conversations GROUP BY 1"
_MEM = f"""l AS (SELECT conv_id AS thread_id, turn, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS place FROM conversations),
m AS (SELECT thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY turn, place) AS INTEGER) AS nth, trim(raw) AS content FROM l WHERE length(trim(raw)) > 40)"""

QUERIES = {
    "o01_corpus_fingerprint": (corpus_fingerprint, "SELECT sha256(count(*) || '|' || max(doc_id) || '|' || max(n_chars) || '|' || max(source)) AS fingerprint FROM documents"),
    "o02_strategy_fingerprints": (strategy_fingerprints, " UNION ALL ".join(f"SELECT '{name}' AS strategy, sha256({S.q(repr(sorted(asdict(config).items())))}) AS fingerprint" for name, config in R.STRATEGIES.items())),
    "o03_retrieval_cache": (retrieval_cache, f"WITH {S.VECTOR_HITS} SELECT q_id AS cache_key, rank, chunk_id FROM (SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY rank) AS INTEGER) AS rank, chunk_id FROM vhits WHERE rank <= 6) WHERE q_id % 7 <> 0 AND q_id % 5 <> 0"),
    "o04_answer_cache": (answer_cache, "SELECT item_id AS q_id, item_id % 3 = 0 AS fresh FROM benchmark WHERE item_id % 2 = 0 OR item_id % 3 = 0"),
    "o05_rerank_cache": (rerank_cache, f"WITH {S.VECTOR_HITS} SELECT q_id, count(*) AS misses FROM vhits WHERE rank <= 30 AND CAST(regexp_extract(chunk_id, '^(\\d+)-', 1) AS BIGINT) % 4 = 0 GROUP BY q_id"),
    "o06_semantic_cache_set": (
        semantic_cache_set,
        """WITH t AS (SELECT * FROM conversations WHERE length(text) >= 10), u AS (SELECT text, min(conv_id) AS c FROM t WHERE role = 'user' GROUP BY text),
        a AS (SELECT text, min(conv_id) AS c FROM t WHERE role <> 'user' AND text NOT IN (SELECT text FROM u) GROUP BY text)
        SELECT count(*) AS entries, CAST(sum(length(text)) AS BIGINT) AS chars, max(c) AS newest FROM (SELECT * FROM u UNION ALL SELECT * FROM a)""",
    ),
    "o07_threads": (threads, _THREADS),
    "o08_memories": (memories, f"WITH {_MEM} SELECT thread_id, nth, md5(content) AS digest, 0.4e0 AS importance FROM m WHERE nth <= 3"),
    "o09_job_list": (job_list, f"WITH {_JOBS} SELECT job_id, job_type, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at DESC, job_id LIMIT 50"),
    "o10_claim_next": (
        claim_next,
        f"""WITH {_JOBS}, d AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY created_at, job_id) AS nth FROM jobs WHERE status IN ('queued', 'retry') AND created_at <= TIMESTAMP '1998-01-01')
        SELECT job_id, job_type, 'worker-1' AS locked_by, TIMESTAMP '1998-01-01' AS locked_at FROM d WHERE nth <= 3""",
    ),
    "o11_backoff": (
        backoff,
        f"""WITH {_JOBS} SELECT job_id, CASE WHEN retries + 1 <= 3 THEN 'retry' ELSE 'failed' END AS status, retries + 1 AS retries,
        CASE WHEN retries + 1 <= 3 THEN TIMESTAMP '1998-01-01' + to_seconds(CAST(least(300, pow(2, retries + 1)) AS BIGINT)) ELSE created_at END AS available_at FROM jobs""",
    ),
    "o12_dispatch": (
        dispatch,
        f"""WITH {_JOBS}, d AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY created_at, job_id) AS nth FROM jobs WHERE status IN ('queued', 'retry') AND created_at <= TIMESTAMP '1999-01-01')
        SELECT job_id, 'succeeded' AS status, CAST((SELECT count(*) FROM jobs j WHERE j.job_type = d.job_type) AS VARCHAR) AS result FROM d WHERE nth = 1""",
    ),
    "o13_request_metrics": (
        request_metrics,
        f"WITH {_REQ} SELECT count(*) AS request_count, count(*) FILTER (status_code >= 500) AS error_count, round(avg(latency_ms), 2) AS avg_latency, quantile_cont(latency_ms, 0.95) AS p95_latency FROM req WHERE created_at >= TIMESTAMP '2024-01-29 12:00:00'",
    ),
    "o13_recent_errors": (recent_errors, f"WITH {_REQ} SELECT request_id, status_code, created_at FROM req WHERE status_code >= 400 ORDER BY created_at DESC, request_id LIMIT 10"),
    "o14_reviews": (reviews, "SELECT coalesce(CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' END, 'pending') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "o15_request_log_dedupe": (request_log_dedupe, f"WITH {_REQ} SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 0 ELSE status_code END AS status_code, client FROM req"),
    "o16_requests_in_window": (requests_in_window, f"WITH {_REQ} SELECT request_id, count(*) OVER (PARTITION BY client ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM req"),
    "o16_rate_limited": (
        rate_limited,
        f"""WITH RECURSIVE {_REQ}, n AS (SELECT client, request_id AS seq, created_at AS at_, row_number() OVER (PARTITION BY client ORDER BY created_at, request_id) AS k FROM req),
        w AS (SELECT client, seq, k, FALSE AS rejected, [at_] AS live FROM n WHERE k = 1 UNION ALL
          SELECT client, seq, k, len(recent) >= 2, CASE WHEN len(recent) >= 2 THEN recent ELSE list_append(recent, at_) END FROM
          (SELECT n.client, n.seq, n.k, n.at_, list_filter(w.live, lambda t: n.at_ - t <= INTERVAL 24 HOUR) AS recent FROM w JOIN n ON n.client = w.client AND n.k = w.k + 1))
        SELECT client, seq, rejected FROM w""",
    ),
    "o06_invalidated": (
        semantic_cache_invalidated,
        "SELECT count(*) AS entries, min(o_orderkey) AS least, CAST(sum(o_custkey) AS BIGINT) AS owners FROM orders WHERE o_custkey % 10 <> 3 AND CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY > TIMESTAMP '1995-01-01'",
    ),
    "o09_enqueued": (
        enqueued_jobs,
        "SELECT o_orderkey AS job_id, o_custkey AS document_id, o_orderpriority AS job_type, 'queued' AS status, 0 AS retries, 3 AS max_retries, TIMESTAMP '1998-01-02' AS created_at FROM orders WHERE o_orderkey % 2 = 1 ORDER BY o_orderkey LIMIT 50",
    ),
    "o13_pending_reviews": (pending_reviews, "SELECT count(*) AS pending_reviews FROM labels WHERE quality IS DISTINCT FROM 1"),
    "o14_created_reviews": (
        created_reviews,
        "SELECT CASE WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS status, 'user' || (doc_id % 3) AS reviewer, CASE WHEN quality = 1 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS created_at, count(*) AS n FROM labels GROUP BY ALL",
    ),
    "o17_tolerant_insert": (tolerant_insert, "SELECT * FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, NULL, NULL FROM supplier"),
    "o18_thread_list": (thread_list, f"SELECT thread_id, turn_count, title FROM ({_THREADS}) ORDER BY turn_count DESC, thread_id LIMIT 20"),
    "o19_health": (health, "SELECT 'documents' AS name, count(*) AS rows, count(*) > 0 AS healthy FROM documents UNION ALL SELECT 'embeddings', count(*), count(*) > 0 FROM embeddings UNION ALL SELECT 'events', count(*), count(*) > 0 FROM events"),
    "o20_excerpts": (
        excerpts,
        f"""WITH {S.VECTOR_HITS}, h AS (SELECT v.q_id, v.rank, {S.squeeze("v.text")} AS t, list_filter(regexp_extract_all(b.text, '\\S+'), lambda w: length(w) > 2) AS terms FROM vhits v JOIN benchmark b ON b.item_id = v.q_id WHERE rank <= 3),
        p AS (SELECT *, coalesce(greatest(0, list_min(list_filter(list_transform(terms, lambda w: strpos(lower(t), lower(w)) - 1), lambda x: x >= 0)) - 90), 0) AS s FROM h)
        SELECT q_id, rank, md5(CASE WHEN s > 0 THEN '... ' ELSE '' END || substring(t, s + 1, 760) || CASE WHEN s + 760 < length(t) THEN ' ...' ELSE '' END) AS digest FROM p""",
    ),
    "o21_slash_commands": (slash_commands, f"WITH {_MEM} SELECT thread_id, nth, 0.4e0 AS importance FROM m WHERE nth <= 3 ORDER BY thread_id DESC, nth DESC LIMIT 10"),
    "p04_valid_requests": (valid_requests, "SELECT length(text) BETWEEN 1 AND 2000 AND conv_id % 25 BETWEEN 1 AND 20 AS valid, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1"),
}
