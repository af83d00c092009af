"""Queries of tokens and of question understanding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.functions import vocabulary as V
from lodestone.plans import sql as S
from lodestone.plans.base import joined, questions, read


def tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.md5(joined(t)).alias("digest"))


def eval_tokens(spark, sf_dir):
    t = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(T.SINGLE_TOKEN), 0), F.lower))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(joined(F.array_sort(t))).alias("digest"))


def expansion(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", joined(Q.expansion(F.col("question"))).alias("expanded"))


def categories(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", Q.category(F.col("text")).alias("category"))


def targets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(Q.target_terms(F.col("text")), ",").alias("targets"))


def target_matches(spark, sf_dir):
    """Titles that each question's targets match; the titles are few."""
    asked = questions(spark, sf_dir).select("q_id", Q.target_terms(F.col("question")).alias("targets"))
    titles = read(spark, sf_dir, "documents").select("source").distinct()
    return asked.join(titles, Q.matches_targets(F.col("source"), F.col("targets"))).groupBy("q_id").agg(F.count("*").alias("n_titles"))


def query_tokens(spark, sf_dir):
    t = Q.query_tokens(F.col("question"))
    return questions(spark, sf_dir).select("q_id", joined(F.array_sort(t)).alias("tokens"), F.size(t).alias("n"))


def focus_tokens(spark, sf_dir):
    t = Q.focus_tokens(F.col("question"))
    return questions(spark, sf_dir).select("q_id", F.size(t).alias("n"), F.md5(joined(F.array_sort(t))).alias("digest"))


def query_hashes(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", Q.query_hash(F.col("question")).alias("query_hash"))


def resolved_pronouns(spark, sf_dir):
    """A user turn with a pronoun begins with the first line of the last answer before it."""
    turns = read(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    hint = F.split(F.substring(F.last(F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(before), 1, 80), "\n")[0]
    asks = T.contains_any(F.col("text"), V.PRONOUNS)
    rows = turns.withColumn("hint", hint).where("role = 'user'")
    resolved = F.when(asks & F.col("hint").isNotNull(), F.concat("hint", F.lit(" — "), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", asks.alias("has_pronoun"), F.md5(resolved).alias("digest"))


def intent_routes(spark, sf_dir):
    """A category is an intent of its own name, or a general question."""
    routes = spark.createDataFrame(list(V.INTENT_AGENTS.items()), "intent string, agent string")
    docs = read(spark, sf_dir, "documents").select(Q.category(F.col("text")).alias("category"))
    intent = F.when(F.col("category").isin("financial", "market"), F.col("category")).when(F.col("category") == "technology", "technical").otherwise("general")
    return docs.select(intent.alias("intent")).groupBy("intent").agg(F.count("*").alias("n")).join(F.broadcast(routes), "intent", "left").select("intent", F.coalesce("agent", F.lit("react_planner")).alias("agent"), "n")


def seed_questions(spark, sf_dir):
    """A question about each document from its category's patterns, in turn by its number."""
    docs = read(spark, sf_dir, "documents").select("doc_id", Q.category(F.col("text"), V.SEED_KEYWORDS).alias("category"), Q.subject(F.col("source")).alias("subject"))
    pattern = Q.by_category(F.col("category"), {name: F.get(F.array(*map(F.lit, patterns)), (F.col("doc_id") % len(patterns)).cast("int")) for name, patterns in V.SEED_PATTERNS.items()}, F.lit(""))
    return docs.select("doc_id", "category", F.replace(pattern, F.lit("{subject}"), F.col("subject")).alias("question"))


_SUBJECT = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(source), {S.q(k.lower())}) THEN {S.q(v)} END" for k, v in V.SEED_SUBJECTS.items()) + ", regexp_extract_all(source, '\\S+')[1], '这家公司')"
_PATTERN = f"CASE {S.category('text', V.SEED_KEYWORDS)} " + " ".join(f"WHEN {S.q(name)} THEN {S.array(patterns)}[doc_id % {len(patterns)} + 1]" for name, patterns in V.SEED_PATTERNS.items()) + " END"
_FOCUS = S.without_noise(f"list_concat({S.tokens(f"array_to_string({S.expansion('text')}, ' ')")}, {S.tokens(S.q(' '.join(V.METRIC_TERMS)))})")

QUERIES = {
    "u01_tokens": (tokens, f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)"),
    "u02_eval_tokens": (eval_tokens, "SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]'), lambda x: lower(x)))) AS t FROM documents)"),
    "u03_expansion": (expansion, f"SELECT item_id AS q_id, array_to_string({S.expansion('text')}, ' ') AS expanded FROM benchmark"),
    "u04_category": (categories, f"SELECT doc_id, {S.category('text')} AS category FROM documents"),
    "u05_targets": (targets, f"SELECT doc_id, array_to_string({S.targets('text')}, ',') AS targets FROM documents"),
    "u06_target_matches": (
        target_matches,
        f"SELECT q_id, count(*) AS n_titles FROM (SELECT item_id AS q_id, {S.targets('text')} AS t FROM benchmark) JOIN (SELECT DISTINCT source FROM documents) ON len(t) = 0 OR len(list_filter(t, lambda x: contains(lower(source), x))) > 0 GROUP BY q_id",
    ),
    "u07_query_tokens": (query_tokens, f"SELECT q_id, array_to_string(list_sort(t), ' ') AS tokens, CAST(len(t) AS INTEGER) AS n FROM (SELECT item_id AS q_id, {S.query_tokens('text')} AS t FROM benchmark)"),
    "u08_focus_tokens": (focus_tokens, f"SELECT q_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT item_id AS q_id, {_FOCUS} AS t FROM benchmark)"),
    "u09_query_hash": (query_hashes, f"SELECT item_id AS q_id, sha256({S.sub('lower(' + S.strip('text') + ')', r'\s+', q_space := S.q(' '))}) AS query_hash FROM benchmark"),
    "u10_pronouns": (
        resolved_pronouns,
        f"""WITH t AS (SELECT *, last_value(CASE WHEN role = 'assistant' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answer FROM conversations)
        SELECT conv_id, turn, {S.any_of("text", V.PRONOUNS)} AS has_pronoun, md5(CASE WHEN {S.any_of("text", V.PRONOUNS)} AND answer IS NOT NULL THEN string_split(substring(answer, 1, 80), chr(10))[1] || ' — ' || text ELSE text END) AS digest FROM t WHERE role = 'user'""",
    ),
    "u11_intent_routes": (
        intent_routes,
        f"""SELECT intent, CASE intent WHEN 'financial' THEN 'financial_agent' ELSE 'react_planner' END AS agent, count(*) AS n FROM
        (SELECT CASE WHEN c IN ('financial', 'market') THEN c WHEN c = 'technology' THEN 'technical' ELSE 'general' END AS intent FROM (SELECT {S.category("text")} AS c FROM documents)) GROUP BY 1""",
    ),
    "u12_seed_questions": (seed_questions, f"SELECT doc_id, {S.category('text', V.SEED_KEYWORDS)} AS category, replace({_PATTERN}, '{{subject}}', {_SUBJECT}) AS question FROM documents"),
}
