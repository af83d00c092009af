from __future__ import annotations

import pytest

from lodestone.engine import Engine
from lodestone.operators.retrieval import RetrievalConfig


def test_questions_are_answered_with_sources(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    engine = Engine.over(docs)
    asked = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("item_id as q_id", "text as question")
    rows = engine.ask(asked).collect()
    assert len(rows) == asked.count() and all(r.answer and r.sources for r in rows)
    hits = engine.retrieve(asked).groupBy("q_id").count().collect()
    assert {r["count"] for r in hits} == {6}
    with pytest.raises(ValueError):
        engine.retrieve(asked, RetrievalConfig(top_k=50))
