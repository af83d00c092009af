"""Every registered query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return connection


def shown(value) -> str:
    if isinstance(value, (list, np.ndarray)):
        return "[" + ",".join(map(shown, value)) + "]"
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "null"
    if isinstance(value, (float, np.floating)):
        return f"{value + 0.0:.9g}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted("|".join(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
