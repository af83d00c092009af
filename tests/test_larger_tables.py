"""Cases that larger tables than the tests' hold."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import registration
from lodestone.operators import answers as A
from lodestone.operators import corpus as C
from lodestone.operators import retrieval as R
from lodestone.operators import vectors as V
from lodestone.operators.index import shared_index
from lodestone.plans import base
from lodestone.sources import readers, shared


def test_row_whose_numbers_are_all_years_stays_without_a_figure(spark):
    asked = "What was the total revenue in 2022?"
    rows = [(1, asked, 1, "2023 2022 2021 Total revenues 2050 2051"), (2, asked, 1, "2023 2022 2021 Total revenues 2050 2051"), (2, asked, 2, "2023 2022 2021 Total revenues 2050 7")]
    found = {r.q_id: (r.label, r.value, r["rank"], r.answer is None) for r in A.direct_facts(spark.createDataFrame(rows, "q_id int, question string, rank int, text string")).collect()}
    assert found == {1: ("total revenues", None, 1, True), 2: ("total revenues", "7", 2, False)}


def test_literals_round_halves_of_the_exact_value_to_even(spark):
    rows = spark.createDataFrame([(1, [0.0078125, -0.0234375, 2.0**-20, None]), (2, None), (3, [])], "vec_id int, embedding array<float>")
    found = {r.vec_id: r.shown for r in rows.select("vec_id", V.literal(F.col("embedding"), 6).alias("shown")).collect()}
    assert found == {1: "[0.007812,-0.023438,0.000001]", 2: None, 3: "[]"}


def test_entities_without_semicolons_and_texts_at_the_end_are_read_as_they_stand(spark):
    pages = [(1, "<title>a&amp;b &amp</title><script>x&&y&amp;</script><p>c &copy; &nosuch; d"), (2, "e & f"), (3, None)]
    found = {r.page_id: r.text for r in spark.createDataFrame(pages, "page_id int, html string").select("page_id", readers.parsed_text(F.col("html")).alias("text")).collect()}
    assert found == {1: "a&b &amp x&&y&amp;\nc \u00a9 &nosuch; d", 2: "e & f", 3: ""}


def test_an_index_stores_no_texts_tokens_or_postings(spark, data):
    docs, folder = spark.read.parquet(f"{data}/documents.parquet").limit(20), f"{shared.shared_folder(spark)}/small-{shared.unique()}"
    index = shared_index(docs, folder)
    stored = {c for table in glob.glob(f"{folder}/*/*") for c in spark.read.parquet(table).columns}
    assert stored and not stored & {"text", "tokens", "chunk_id"}
    asked = spark.read.parquet(f"{data}/benchmark.parquet").where("item_id < 2").selectExpr("item_id as q_id", "text as question")
    told = R.understood(asked)
    best = {(r.q_id, r.chunk_id, r.score) for r in R.lexical(index, told, 3).collect()}
    order = Window.partitionBy("q_id", "chunk_level").orderBy(F.desc("score"), "chunk_id")
    every = R.lexical(index, told).withColumn("nth", F.row_number().over(order)).where("nth <= 3")
    assert best == {(r.q_id, r.chunk_id, r.score) for r in every.collect()} and len(best) >= 6
    none = R.lexical(index, told.where("q_id < 0"))
    assert "MapInArrow" not in _plan(none) and none.count() == 0 and none.columns == R.lexical(index, told).columns
    assert R.retrieve(index, told.where("q_id < 0")).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_neighbours_shuffle_no_vectors_and_no_candidates(spark):
    vectors = spark.createDataFrame([(k, [1.0, float(k % 7), float(k % 11)]) for k in range(200)] + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0])], "vec_id long, embedding array<float>")
    near = V.approximate_nearest(vectors, 50, 3)
    assert "Join" not in _plan(near) and "Generate" not in _plan(near)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in near.collect()}
    assert found[0, 1] == (77, 0.0) and found[0, 2] == (154, 0.0) and {q for q, _ in found} == {0, 50, 100, 150}
    assert all(r.distance > 0 for r in near.where("rank = 3").collect())


def test_page_statistics_shuffle_no_lines_and_agree_with_the_kept_lines(spark):
    body = [f"body {'abcdefghij'[k]} of page" for k in range(8)]
    pages = [("a", k, "\n".join(["Annual Report 2020", *(f"{x} {'klmno'[k]}" for x in body), f"Page {k}"])) for k in range(5)] + [("a", 4, "other first\nother last"), ("b", 1, "one\ntwo"), ("b", 2, None)]
    kept, stats = C.clean_pages(spark.createDataFrame(pages, "doc string, page long, text string"))
    assert "posexplode" not in _plan(stats)
    assert {r.doc: tuple(r)[1:] for r in stats.collect()} == {"a": (6, 5, 10, 1, 3), "b": (2, 1, 0, 1, 1)}
    lines = [(r.doc, r.page, r.idx) for r in kept.collect()]
    assert sorted(lines) == sorted([("a", k, i) for k in range(5) for i in range(1, 9)] + [("a", 4, 0), ("a", 4, 1), ("b", 1, 0), ("b", 1, 1)])


def test_texts_without_ideographs_are_not_read_token_by_token(monkeypatch):
    texts = ["Stra\u00dfe 12-B\u00c4\u0130x \u212a9", "", None, "one", "\u00e9\u00e9", "Tesla \u5b81\u5fb7\u65f6\u4ee3 2023\u8425\u6536 A"]
    assert [registration.tokens_of(x) for x in texts[:5]] == [["stra", "e", "12", "b", "x", "9"], [], [], ["one"], []]
    assert registration.tokens_of(texts[5]) == ["tesla", "\u5b81\u5fb7\u65f6\u4ee3", "\u5b81\u5fb7", "\u5fb7\u65f6", "\u65f6\u4ee3", "2023", "\u8425\u6536", "a"]
    monkeypatch.setattr(registration, "_TOKEN", None)
    assert registration.tokens_of("One two\u00e4 3") == ["one", "two", "3"]


def test_large_documents_of_one_file_are_not_shuffled(spark, data, tmp_path):
    texts = [os.urandom(2_000_000).hex() for _ in range(10)]
    table = pa.table({"doc_id": list(range(10)), "text": texts, "lang": ["en"] * 10, "source": ["src1"] * 10})
    pa.parquet.write_table(table, f"{tmp_path}/documents.parquet", row_group_size=1)
    assert "Exchange" not in _plan(base.chunks(spark, str(tmp_path)))
    assert "Exchange" in _plan(base.chunks(spark, data))
