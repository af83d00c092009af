"""Queries of entities and relations; the dictionary is the longest words of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans import sql as S
from lodestone.plans.base import read


def _dictionary(spark, sf_dir):
    """Each item's longest word, by its length a company, a domain or a product."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("name"))
    best = words.groupBy("item_id").agg(F.min(F.struct((-F.char_length("name")).alias("less"), "name")).alias("best")).select("best.name").distinct()
    kind = F.when(F.char_length("name") % 3 == 0, "company").when(F.char_length("name") % 3 == 1, "domain").otherwise("product")
    return best.select("name", kind.alias("entity_type"))


def _mentions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return G.mentions(docs, _dictionary(spark, sf_dir))


def mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)


def entity_types(spark, sf_dir):
    """Titles with and without the words that tell a type."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("集团"))).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit("年报"))).when(F.col("doc_id") % 4 == 2, F.lit("Tesla")).otherwise(F.col("source")).alias("name"))
    return docs.select("doc_id", G.entity_type(F.col("name")).alias("entity_type"), G.normalized_name(F.col("name")).alias("normalized_name"))


def line_relations(spark, sf_dir):
    """The first word of a line is a head, parted by a colon, and two words are hints."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.regexp_replace("text", r"(?m)^(\S+) ", "- $1: ").alias("text"))
    rows = G.line_relations(docs, [("the", "includes"), ("une", "covers")])
    return rows.groupBy("chunk_id", "relation").agg(F.count("*").alias("n"), F.countDistinct("head").alias("n_heads"))


def cooccurrences(spark, sf_dir):
    return G.cooccurrences(_mentions(spark, sf_dir))


def entities(spark, sf_dir):
    return G.entities_of(_mentions(spark, sf_dir))


def merged_relations(spark, sf_dir):
    """Co-occurrences at .7, and those of even documents again at .9."""
    rows = G.cooccurrences(_mentions(spark, sf_dir))
    merged = G.merged_relations(rows.withColumn("confidence", F.lit(0.7)), rows.where("chunk_id % 2 = 0").withColumn("confidence", F.lit(0.9)))
    return merged.groupBy("confidence").agg(F.count("*").alias("n"))


def fact_list(spark, sf_dir):
    """Customers are facts here: those of a name pattern and a segment, by balance, the first 50."""
    rows = read(spark, sf_dir, "customer").where(F.col("c_name").ilike("%1%") & (F.col("c_mktsegment") == "BUILDING"))
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_name", "c_acctbal")


def companies(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_pending"), F.round(F.max("c_acctbal"), 2).alias("highest"))


_DICT = """d AS (SELECT DISTINCT name, CASE length(name) % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'domain' ELSE 'product' END AS entity_type FROM
  (SELECT item_id, w[1] AS name FROM (SELECT item_id, list_sort(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: {'l': -length(x), 'n': x})) AS ws FROM benchmark), LATERAL (SELECT [ws[1].n] AS w))),
parts AS (SELECT doc_id AS chunk_id, name, entity_type, string_split(text, name) AS p FROM documents JOIN d ON contains(text, name)),
m AS (SELECT chunk_id, name, entity_type, unnest(list_transform(range(1, len(p)), lambda k: CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(name) AS INTEGER))) AS start FROM parts),
n AS (SELECT DISTINCT chunk_id, name, entity_type FROM m),
co AS (SELECT a.chunk_id, a.name AS head, 'related_to' AS relation, b.name AS tail FROM n a JOIN n b ON a.chunk_id = b.chunk_id AND a.entity_type = 'company' AND b.entity_type IN ('domain', 'product') AND a.name <> b.name)"""

QUERIES = {
    "g01_mentions": (mentions, f'WITH {_DICT} SELECT chunk_id, name, entity_type, start, CAST(start + length(name) AS INTEGER) AS "end" FROM m'),
    "g02_entity_types": (
        entity_types,
        "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'company_or_domain' WHEN 1 THEN 'document' WHEN 2 THEN 'company' ELSE 'concept' END AS entity_type, lower(CASE doc_id % 4 WHEN 0 THEN source || '集团' WHEN 1 THEN source || '年报' WHEN 2 THEN 'Tesla' ELSE source END) AS normalized_name FROM documents",
    ),
    "g03_line_relations": (
        line_relations,
        f"""WITH l AS (SELECT doc_id AS chunk_id, {S.strip("unnest(string_split(text, chr(10)))")} AS raw FROM documents), x AS (SELECT chunk_id, regexp_replace(raw, '^(\\S+) ', '- \\1: ') AS line FROM l),
        y AS (SELECT chunk_id, line, trim(substring(line, 1, strpos(line, ':') - 1), ' -*•') AS head, {S.strip("substring(line, strpos(line, ':') + 1)")} AS tail FROM x WHERE contains(line, ':')),
        z AS (SELECT chunk_id, head, unnest(list_filter([CASE WHEN contains(line, 'the') THEN 'includes' END, CASE WHEN contains(line, 'une') THEN 'covers' END], lambda h: h IS NOT NULL)) AS relation FROM y WHERE head <> '' AND tail <> '')
        SELECT chunk_id, relation, count(*) AS n, count(DISTINCT head) AS n_heads FROM z GROUP BY ALL""",
    ),
    "g04_cooccurrences": (cooccurrences, f"WITH {_DICT} SELECT chunk_id, head, relation, tail FROM co"),
    "g05_entities": (entities, f"WITH {_DICT} SELECT lower(name) AS normalized_name, entity_type, min(name) AS name, min(chunk_id) AS source_chunk_id, count(*) AS mentions FROM m GROUP BY 1, 2"),
    "g06_merged_relations": (merged_relations, f"WITH {_DICT} SELECT CASE WHEN chunk_id % 2 = 0 THEN 0.9e0 ELSE 0.7e0 END AS confidence, count(*) AS n FROM co GROUP BY 1"),
    "g07_fact_list": (fact_list, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name ILIKE '%1%' AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50"),
    "g07_companies": (companies, "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_pending, round(max(c_acctbal), 2) AS highest FROM customer GROUP BY 1"),
}
