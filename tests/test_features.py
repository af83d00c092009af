"""What the registered queries don't reach: functions for SQL, the planner, commands, and odd rows."""

from __future__ import annotations

import pandas as pd
import pytest

from lodestone import main
from lodestone.engine import Engine
from lodestone.functions import registration
from lodestone.functions import text as T
from lodestone.operators import agent, state
from lodestone.operators import retrieval as R
from lodestone.operators import vectors as vectors_
from lodestone.operators.index import opened, shared_index
from lodestone.sources import shared

F = R.F


@pytest.fixture(scope="module")
def engine(spark, data):
    return Engine.over(spark.read.parquet(f"{data}/documents.parquet"))


def test_table_functions_equal_the_columns(spark, data):
    registration.register(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("select doc_id, c.chunk from some_docs, lateral lodestone_chunks(text) c").collect()
    want = docs.where("text rlike '\\\\S'").select("doc_id", F.explode(T.windows(F.col("text"))).alias("chunk")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    counts = spark.sql("select doc_id, lodestone_token_count(text) as n from some_docs").collect()
    assert sorted(map(tuple, counts)) == sorted(map(tuple, docs.select("doc_id", F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0))).collect()))


def test_the_planner_searches_until_it_knows(spark, data, engine):
    asked = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("item_id as q_id", "text as question").limit(3)

    def planner(seen: pd.Series) -> pd.Series:
        return seen.map(lambda x: "FINAL: done" if x.count("\n[1] ") >= 2 else x.split("\n\n")[0][:200])

    rows = agent.planned(engine, asked, planner).collect()
    assert len(rows) == 3 and all(r.final == "done" and len(r.observations) == 2 for r in rows)
    assert all(len(x) <= agent.OBSERVED_CHARS + 20 for r in rows for x in r.observations)


def test_tools_filter_by_name(spark, engine):
    pairs = spark.createDataFrame([(1, "src1", "src2", "the")], "q_id long, company_a string, company_b string, aspect string")
    assert all(("src1" if r.q_id == "1a" else "src2") in r.document_title for r in engine.compare_companies(pairs).collect())
    lookup = spark.createDataFrame([(1, "src3", "the", "")], "q_id long, company string, metric string, year string")
    assert all("src3" in r.document_title for r in engine.extract_financials(lookup).collect())
    summary = spark.createDataFrame([(1, "src3")], "q_id long, document string")
    assert engine.summarize_document(summary).count() <= 8
    assert engine.retrieve_docs(spark.createDataFrame([(1, "the")], "q_id long, question string"), 50).count() <= 10


def test_a_model_of_pairs_orders_the_hits(spark, data, engine):
    asked = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("item_id as q_id", "text as question").limit(5)
    shortest = R.Reranker("shortest", lambda question, text: -text.str.len().astype("float64"))
    config = R.RetrievalConfig(recall_weight=0.0)
    told = R.retrieve(engine.index, asked, config, reranker=shortest).collect()
    best = {q: min(len(r.text) for r in told if r.q_id == q) for q in {r.q_id for r in told}}
    assert all(len(r.text) == best[r.q_id] for r in told if r.rank == 1)


def test_intents_by_a_model(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "q_id long, question string")
    rows = agent.classified(asked, lambda q: q.map({"a": " Summary", "b": "nonsense", "c": None}.get)).collect()
    assert {r.q_id: (r.intent, r.agent) for r in rows} == {1: ("summary", "summary_agent"), 2: ("general", "react_planner"), 3: ("general", "react_planner")}


def test_an_index_is_made_once(spark, data):
    docs, folder = spark.read.parquet(f"{data}/documents.parquet").limit(20), f"{shared.shared_folder(spark)}/once-{shared.unique()}"
    first, again = shared_index(docs, folder), shared_index(docs.repartition(3), folder)
    assert first.chunks.inputFiles() == again.chunks.inputFiles()
    assert opened(spark, folder + "/none") is None


def test_nearest_vectors_of_odd_rows(spark, monkeypatch):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [1.0]), ("g", [2.0, 0.0])], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0])], "q_id long, embedding array<float>")
    want = {(1, "a", 1), (1, "g", 2), (2, "b", 1), (2, "a", 2)}
    for most in (20_000, 1):
        monkeypatch.setattr(vectors_, "MOST_QUERIES", most)
        assert {(r.q_id, r.chunk_id, r["rank"]) for r in R.nearest(vectors, queries, 2).collect()} == want


def test_rejected_requests_do_not_count(spark):
    rows = spark.createDataFrame([("a", k, f"2024-01-01 00:00:{k:02}") for k in range(50)], "client string, seq long, at string").withColumn("at", F.col("at").cast("timestamp"))
    found = [r.rejected for r in state.rate_limited(rows, 2, 10).orderBy("seq").collect()]
    want, accepted = [], []
    for k in range(50):
        accepted = [x for x in accepted if k - x <= 10]
        want.append(len(accepted) >= 2)
        accepted += [] if want[-1] else [k]
    assert found == want


def test_commands(spark, data, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one_file.md").write_text("# Head\ntext of it\n# Next\nmore")
    main.seed(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert {(r.chunk_index, r.section_title) for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()} == {(0, "Head"), (1, "Next")}
    main.repair(spark, str(tmp_path / "tables"), str(tmp_path / "wide"))
    assert spark.read.parquet(str(tmp_path / "wide/reviews")).columns[0] == "review_id"
    with pytest.raises(SystemExit):
        main.main(["unknown"])
