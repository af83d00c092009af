"""What the operators that run Python over Arrow batches share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch that comes from the JVM, and the text bytes that are worked on at once.
#: One row is always taken whole, however long its text.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 500, 4 << 20, 1 << 20
#: Numbers that a task remembers at once, about 70 bytes each.
SEEN = 200_000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, for tables whose rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about ``most`` bytes; a longer text goes alone."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return freed memory to the machine, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of Arrow batches that gives back memory when it is done."""

    def each(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return each


def tidy_table(run: Callable[[pa.Table], pa.Table]) -> Callable:
    """A function of a group's table that gives back memory after each group."""

    def once(table):
        try:
            return run(table)
        finally:
            give_back()

    return once


def columns_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that no other column of the table can clash with what is added."""
    small_batches(df.sparkSession)
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))


def rows_where(df: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows for whose texts ``keep`` says so, batch by batch, with all their columns."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, at):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one after another, as tuples."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


class Seen:
    """Numbers that a task has met, in bounded memory: a full memory is emptied.

    So what it calls new may have been met before; what it calls old always has.
    """

    def __init__(self, most: int = SEEN):
        self.most, self.held = most, set()

    def new(self, value: int) -> bool:
        if value in self.held:
            return False
        if len(self.held) >= self.most:
            self.held.clear()
        self.held.add(value)
        return True


class Output:
    """Gathers output columns and hands out batches of bounded size.

    ``types`` are Arrow types by column; ``add`` takes one row and tells whether a batch is due.
    """

    def __init__(self, schema: pa.Schema, rows: int = 4096, size: int = 8 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.held = 0

    def add(self, *row: object, size: int = 0) -> bool:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.held += size
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return out
