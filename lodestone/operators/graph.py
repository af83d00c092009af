"""Entities, mentions and relations of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vocabulary as V


def normalized_name(name: Column) -> Column:
    return F.lower(T.squeeze(name))


def mentions(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """All places of dictionary names in texts: chunk_id, name, entity_type, start, end (from 0).

    ``entities`` (name, entity_type) is a dictionary and joined by containment; places follow from
    the lengths of the parts between occurrences, which do not overlap.
    """
    found = chunks.select("chunk_id", "text").join(entities, F.contains(F.col("text"), F.col("name")))
    parts = F.split("text", F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")), -1)
    counts = F.transform(parts, F.char_length)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(counts, 1, k), F.lit(0), lambda s, x: s + x) + (k - 1) * F.char_length("name"))
    rows = found.select("chunk_id", "name", "entity_type", F.explode(starts).alias("start"))
    return rows.withColumn("end", F.col("start") + F.char_length("name"))


def entity_type(name: Column) -> Column:
    known = [F.when(name == key, F.lit(kind)) for key, kind in V.ENTITY_TYPES.items()]
    return F.coalesce(*known, F.when(name.rlike("(公司|集团|能源|电力|科技|电池|光伏|储能|风电)"), "company_or_domain").when(name.rlike("(年报|季报|公告|报告|白皮书)"), "document").otherwise("concept"))


def line_relations(chunks: DataFrame, hints: list[tuple[str, str]] | None = None) -> DataFrame:
    """Relations of lines "left: right" that hold a hint: chunk_id, head, relation, tail.

    A full-width colon parts before a plain one does.
    """
    hints = V.RELATION_HINTS if hints is None else hints
    rows = chunks.select("chunk_id", F.explode(T.trimmed_lines(F.col("text"))).alias("line"))
    colon = F.when(F.contains("line", F.lit("：")), "：").when(F.contains("line", F.lit(":")), ":")
    at = F.when(F.contains("line", F.lit("：")), F.locate("：", F.col("line"))).otherwise(F.locate(":", F.col("line")))
    rows = rows.where(colon.isNotNull()).withColumn("at", at)
    rows = rows.withColumn("head", F.btrim(F.substring("line", F.lit(1), F.col("at") - 1), F.lit(" -*•"))).withColumn("tail", T.strip(F.substring("line", F.col("at") + 1, F.char_length("line"))))
    found = F.array_compact(F.array(*(F.when(F.contains("line", F.lit(hint)), F.lit(kind)) for hint, kind in hints), F.when(F.contains("line", F.lit("与")) & F.contains("line", F.lit("相关")), "related_to")))
    return rows.select("chunk_id", "head", F.explode(found).alias("relation"), "tail").where("head <> '' and tail <> ''")


def cooccurrences(mentioned: DataFrame) -> DataFrame:
    """Companies with the domains and products of the same chunk: chunk_id, head, relation, tail."""
    names = mentioned.select("chunk_id", "name", "entity_type").distinct()
    left = names.where("entity_type = 'company'").select("chunk_id", F.col("name").alias("head"))
    right = names.where("entity_type in ('domain', 'product', 'company_or_domain')").select("chunk_id", F.col("name").alias("tail"))
    return left.join(right, "chunk_id").where("head <> tail").select("chunk_id", "head", F.lit("related_to").alias("relation"), "tail")


def entities_of(mentioned: DataFrame) -> DataFrame:
    """Entities by normalised name and type, with their first chunk and number of mentions."""
    return mentioned.groupBy(normalized_name(F.col("name")).alias("normalized_name"), "entity_type").agg(F.min("name").alias("name"), F.min("chunk_id").alias("source_chunk_id"), F.count("*").alias("mentions"))


def merged_relations(*parts: DataFrame) -> DataFrame:
    """Relations by head, relation, tail and chunk with their highest confidence."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("head", "relation", "tail", "chunk_id").agg(F.max("confidence").alias("confidence"))
