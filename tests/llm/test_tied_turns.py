from __future__ import annotations

import duckdb

from lodestone.llm import chat


def test_conversations_that_end_inside_tied_turns_go(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 0, "user", "yo"), (3, None, "user", "a"), (4, None, "user", "a"), (4, None, "user", "b"), (4, 1, "user", "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    connection = duckdb.connect()
    connection.register("conversations", table.toPandas())
    got = sorted(map(tuple, chat.format_conversations(table).collect()))
    assert got == sorted(connection.sql(chat.ORACLE_SQL).fetchall()) and {r[0] for r in got} == {2, 4}


def test_many_texts_of_one_turn_come_in_parts(spark, monkeypatch):
    rows = [(1, None if k % 3 else -5, "user", f"text {k:03}") for k in range(300)] + [(1, 600, "user", "last"), (2, 300, "user", "<|im_end|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    connection = duckdb.connect()
    connection.register("conversations", table.toPandas().astype({"turn": "Int64"}))
    got = sorted(map(tuple, chat.format_conversations(table).collect()))
    assert got == sorted(connection.sql(chat.ORACLE_SQL).fetchall()) and [(r[0], r[1], r[2]) for r in got] == [(1, 0, 301), (1, 1, 301), (2, 0, 1)]
