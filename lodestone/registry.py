"""All registered queries outside the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import answers, evaluation, graph, operations, query, retrieval, sources, stream, text, vectors

_MODULES = (sources, text, query, retrieval, vectors, answers, graph, evaluation, operations, stream)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
