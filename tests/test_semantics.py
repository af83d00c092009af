"""Small cases of the text, query, answer and state semantics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.operators import evaluation as E
from lodestone.operators import retrieval as R
from lodestone.operators import state as S
from lodestone.operators import vectors as V
from lodestone.sources import readers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("out")).first()["out"]


def test_ideographs_give_the_run_and_its_pairs(spark):
    assert sorted(one(spark, T.tokens(F.col("t")), t="宁德时代2023营收")) == sorted(["宁德时代", "宁德", "德时", "时代", "2023", "营收"])


def test_category_without_keywords_and_ties_is_the_first(spark):
    assert one(spark, Q.category(F.col("t")), t="nothing here") == "financial"
    assert one(spark, Q.category(F.col("t")), t="market order") == "market"


def test_direct_fact_takes_the_asked_year(spark):
    text = "In millions 2023 2022 2021 Total automotive revenues 82,419 71,462 47,232"
    hits = spark.createDataFrame([(1, "What were automotive revenues in 2022?", 1, text), (2, "How many vehicles were delivered in 2023?", 1, "In 2023, we produced 1,845,985 vehicles and delivered 1,808,581 consumer vehicles.")], "q_id int, question string, rank int, text string")
    found = {r.q_id: r.value for r in A.direct_facts(hits).collect()}
    assert found == {1: "71,462", 2: "1,808,581"}


def test_citations_beyond_the_sources_vanish(spark):
    assert one(spark, T.clean_citations(F.col("t"), F.lit(2)), t="See [1]至[], and [9] .") == "See [1], and."


def test_windows_at_their_bounds(spark):
    for n, pieces in ((179, 1), (180, 1), (181, 2), (325, 2), (326, 3)):
        assert len(one(spark, T.windows(F.col("t")), t=" ".join(["w"] * n))) == pieces


def test_fingerprint_folds_sharp_s(spark):
    assert one(spark, T.paragraph_fingerprint(F.lit("Straße 12")) == T.paragraph_fingerprint(F.lit("STRASSE 7")))


def test_fusion_of_one_and_two_lists(spark):
    lexical = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "q_id int, chunk_id string, score double")
    vectors = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "q_id int, chunk_id string, rank int")
    found = {r.chunk_id: r.score for r in R.fused(lexical, vectors, R.RetrievalConfig()).collect()}
    assert found == {"a": round(2 / 61, 9), "b": round(1 / 62, 9), "c": round(1 / 62, 9)}


def test_equal_scores_blend_to_a_half(spark):
    hits = spark.createDataFrame([(1, "a", 2.0, 7.0), (1, "b", 2.0, 7.0)], "q_id int, chunk_id string, score double, model_score double")
    assert {r.blend for r in R.blended(hits).collect()} == {0.5}


def test_pages_match_within_five(spark):
    pages = lambda *x: E.page_matches(*map(F.lit, x))
    assert one(spark, pages(15, 15, 5, 10)) and not one(spark, pages(16, 16, 5, 10))
    assert one(spark, E.page_matches(F.lit(1), F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int")))


def test_backoff_doubles_up_to_five_minutes(spark):
    assert [one(spark, S.backoff_seconds(F.lit(n))) for n in range(1, 10)] == [2, 4, 8, 16, 32, 64, 128, 256, 300]


def test_money_beats_a_year(spark):
    assert tuple(one(spark, A.fact_value(F.col("t")), t="In 2023 it was $82,419 million")) == ("82,419", "USD million")


def test_ungrounded_numbers_go(spark):
    cleaned = one(spark, A.guarded(F.col("a"), F.col("e")), a="It sold 12 of 1,300.", e="We had 1300 here")
    assert cleaned.startswith("It sold of 1,300.") and "注" in cleaned


def test_rejected_requests_do_not_count(spark):
    rows = [("c", k, datetime(2024, 1, 1, 0, 0, s)) for k, s in enumerate((0, 1, 2, 3, 50))]
    found = S.rate_limited(spark.createDataFrame(rows, "client string, seq long, at timestamp"), limit=2, seconds=10).orderBy("seq").collect()
    assert [r.rejected for r in found] == [False, False, True, True, False]


def test_cached_lists_with_a_missing_chunk_miss(spark):
    cache = spark.createDataFrame([("k", ["a", "b"], None), ("m", ["a", "z"], None), ("x", ["a"], datetime(2023, 1, 1))], "cache_key string, chunk_ids array<string>, expires_at timestamp")
    found = S.cache_lookup(cache, spark.createDataFrame([("a",), ("b",)], "chunk_id string"), F.to_timestamp(F.lit("2024-01-01")))
    assert sorted((r.cache_key, r.rank, r.chunk_id) for r in found.collect()) == [("k", 1, "a"), ("k", 2, "b")]


def test_approximate_neighbours_recall(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    near = V.approximate_nearest(vectors, 50, 5).select("query_id", "vec_id")
    own = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    exact = R.nearest(vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), own, 6)
    exact = exact.where(F.col("q_id").cast("string") != F.col("chunk_id")).select(F.col("q_id").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"))
    assert near.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * near.count()


def test_parsed_html_keeps_script_text(spark):
    html = "<p>a<b>b</b></p><script>var t;</script><div>c &amp; d</div>"
    assert one(spark, readers.parsed_text(F.col("h")), h=html) == "a b\nvar t;\nc & d"
