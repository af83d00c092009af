from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import bytenet, chat, entry, langid, topk


def brute_force(rows, k=20, every=20):
    usable = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, w in usable.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, v in usable.items() if i != q)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("block", [65_536, 64])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(0, 0.2, 9).round(2).tolist()) for k in range(300)]
    rows += [(k, [0.5] * 9) for k in range(300, 380)] + [(400, None), (420, [float("nan")] * 9), (440, [None] * 9), (460, [0.0] * 9), (480, [0.1] * 4), (None, [0.3] * 9)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rank string")
    want = brute_force([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    assert {tuple(r) for r in topk.exact_top_k(table).collect()} == want
    assert topk.exact_top_k(table.limit(0)).count() == 0


def test_large_components_are_ranked_by_their_whole_score(spark):
    rows = [(0, [1e300, 1.0]), (1, [3e17, 0.5]), (2, [-1e300, 2.0]), (3, [0.5, 0.25]), (4, [2.0**34, 7.0]), (5, [float("inf"), 1.0]), (20, [0.25, -3e17])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [max(-topk.LARGEST, min(topk.LARGEST, int(np.floor(64 * x)) if abs(x) < 1e16 else int(x) * 64)) for x in v] for i, v in rows if np.isfinite(v).all()}
    want = set()
    for q in (0, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        want |= {(q, r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scores, 1)}
    assert {tuple(r) for r in topk.exact_top_k(table).collect()} == want


def test_rows_that_share_an_id_count_once(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(table).orderBy("rank").collect()] == [(0, 1, 1, 4096), (0, 2, 2, 2048)]


def same_as_sql(spark, table):
    connection = duckdb.connect()
    conversations = table.toPandas()  # noqa: F841
    connection.register("conversations", conversations)
    got = sorted(map(tuple, chat.format_conversations(table).collect()))
    want = sorted(connection.sql(chat.ORACLE_SQL).fetchall())
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [tuple(r) for r in want]
    return got


def test_snapshots_collapse_to_the_longest(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 256)
    turns = ["hello", "hi", "how?", "so", None, "end"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", turns[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 6)) for t in range(n)]
    rows += [(5, 0, "user", "hello"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other"), (6, 0, None, "x"), (6, None, "user", "y")]
    rows += [(7, t, "user", f"t{t}") for t in range(600)] + [(8, t, "user", f"t{t}") for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = same_as_sql(spark, table)
    assert {r[0] for r in kept} == {4, 5, 6, 7}
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_rows_without_a_conversation_go(spark):
    table = spark.createDataFrame([(None, 0, "user", "x"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.format_conversations(table).collect()] == [1]


def test_registered_queries_equal_sql(spark, data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    for name, sql in entry.oracle_sql().items():
        got = entry.queries()[name](spark, data)
        want = connection.sql(sql)
        columns = ", ".join(sorted(got.columns))
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(str(r) for r in spark.createDataFrame(want.select(columns).fetchall(), got.select(*sorted(got.columns)).schema).collect())


def test_stages_keep_the_columns_and_their_input(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "line_dedup", "ngram_jaccard_join", "packing"]
    before, ids = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data)
        assert after.columns == docs.columns, name
        new = {r.doc_id for r in after.select("doc_id").collect()}
        assert new and (ids is None or new <= ids)
        before, ids = spark.createDataFrame(after.collect(), docs.schema), new
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert {r.doc_id for r in pieces.collect()} == ids


def test_stages_take_odd_and_empty_tables(spark, docs, data):
    rng = random.Random(1)
    table = docs(None, "", "12 34", "x " * 50, *(" ".join(rng.choice(["good", "words", "here", "and", "there"]) for _ in range(30)) for _ in range(5)))
    for odd in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, odd, data)
            assert out.count() >= 0 and (name == "packing" or out.columns == table.columns)


def test_models_reject_what_they_say(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    table = docs("Thou and the words of it are here for thee to read on this day.", "### $$$ %%% " * 50)
    kept = {r.doc_id for r in bytenet.without_rejected(table, labels).collect()}
    scored = {r.doc_id for r in bytenet.classify(table, labels).collect() if r.predicted}
    assert kept <= {0, 1} and len(scored) <= 2
    assert {r.doc_id for r in langid.with_a_language(docs("hello there", "123", None)).collect()} == {0}
