"""Exact top-k inner products by a bit-sliced index."""

from __future__ import annotations

from decimal import Decimal
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import written

#: Rows of one index block (a multiple of 64), queries of one query block, query blocks that one task takes.
BLOCK_ROWS, BLOCK_QUERIES, TASK_BLOCKS = 65_536, 256, 64
#: Quantised components beyond this count as this.
LARGEST = 1 << 40


class SlicedBlock:
    """Whole-numbered attributes of a block of rows as bitmaps over the rows.

    ``slices[d][b]`` has bit b of attribute d less its least value. Rows stand in the order of
    their ids, so that the first set bits of a bitmap are the smallest ids.
    """

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: list[list[np.ndarray]]):
        self.ids, self.low, self.slices = ids, low, slices

    @staticmethod
    def pack(ids: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """ids, least values, numbers of slices and bitmaps of a block, as bytes."""
        by = np.argsort(ids, kind="stable")
        ids, values = ids[by], values[by]
        low = values.min(axis=0)
        rest = values - low
        width = [int(x).bit_length() for x in rest.max(axis=0)]
        size = ceil(len(ids) / 64) * 64
        maps = [np.packbits(np.pad(rest[:, d] >> b & 1, (0, size - len(ids))).astype(np.uint8), bitorder="little").tobytes() for d, w in enumerate(width) for b in range(w)]
        return ids.tobytes(), low.tobytes(), np.array(width, np.int64).tobytes(), b"".join(maps)

    @classmethod
    def unpack(cls, ids: bytes, low: bytes, width: bytes, maps: bytes) -> SlicedBlock:
        names = np.frombuffer(ids, np.int64)
        bitmaps = iter(np.frombuffer(maps, np.uint64).reshape(-1, ceil(len(names) / 64)))
        return cls(names, np.frombuffer(low, np.int64), [[next(bitmaps) for _ in range(w)] for w in np.frombuffer(width, np.int64)])

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the weighted sum of the attributes, least first, and what is to be added to it.

        A negative weight takes the complement of its attribute, so that all parts are added. Each
        column of equal weight is summed by full adders, whose carries go to the next column.
        """
        columns: list[list[np.ndarray]] = []
        shift = int(sum(int(q) * int(x) for q, x in zip(query, self.low, strict=True)))
        for q, maps in zip(query.tolist(), self.slices, strict=True):
            if not q or not maps:
                continue
            if q < 0:
                shift += q * ((1 << len(maps)) - 1)
                maps = [~m for m in maps]
                q = -q
            place = 0
            while q:
                if q & 1:
                    while len(columns) < place + len(maps):
                        columns.append([])
                    for b, bitmap in enumerate(maps):
                        columns[place + b].append(bitmap)
                q >>= 1
                place += 1
        total, at = [], 0
        while at < len(columns):
            column = columns[at]
            if len(column) > 1 and at + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                carry = half & c
                half ^= c
                a = a & b
                carry |= a
                column.insert(0, half)
                columns[at + 1].append(carry)
            if len(column) == 2:
                a, b = column
                columns[at + 1].append(a & b)
                total.append(a ^ b)
            else:
                total.append(column[0] if column else np.zeros(ceil(len(self.ids) / 64), np.uint64))
            at += 1
        return total, shift

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k highest rows but the query's own; ties go to smaller ids.

        From the most significant slice down: rows that are surely in, and rows still equal with the
        boundary. What is left at the end has the boundary's score, and its first rows are taken.
        """
        slices, shift = self.add(query)
        equal = np.full(ceil(len(self.ids) / 64), ~np.uint64(0))
        if len(self.ids) % 64:
            equal[-1] = np.uint64((1 << len(self.ids) % 64) - 1)
        at = int(np.searchsorted(self.ids, own))
        if at < len(self.ids) and self.ids[at] == own:
            equal[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        sure, n_sure = np.zeros_like(equal), 0
        for bitmap in reversed(slices):
            above = equal & bitmap
            n = n_sure + int(np.bitwise_count(above).sum())
            if n > k:
                equal = above
            else:
                sure, n_sure = sure | above, n
                equal = equal & ~bitmap
                if n == k:
                    break
        rows = np.concatenate([_set_bits(sure), _set_bits(equal)[: k - n_sure]])
        kind = object if len(slices) > 61 or abs(shift) >= 1 << 62 else np.int64  # whole numbers of any size, or fast ones
        score = np.full(len(rows), shift, kind)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for b, bitmap in enumerate(slices):
            score += (bitmap[word] >> bit & np.uint64(1)).astype(np.int64).astype(kind) << b
        return self.ids[rows], score


def _set_bits(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and floor(scale * x) of each component, within LARGEST, for vectors without null or non-finite ones."""
    vector = F.col("vector")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    found = source.where(F.col("vec_id").isNotNull() & vector.isNotNull()).where(whole)
    return found.groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vec_id", F.transform(vector, lambda x: F.floor(F.greatest(F.least(x, F.lit(LARGEST / scale)), F.lit(-LARGEST / scale)) * scale).cast("long")).alias("value"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    width = max(map(len, rows), default=0)
    return np.array([row + [0] * (width - len(row)) for row in rows], np.int64).reshape(len(rows), width)


def exact_top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, the k other rows of the highest inner product.

    Rows: query_id, rank (from 1), vec_id, score. Components are floor(scale * x); ties go to the
    smaller id; fewer candidates give fewer rows. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; of rows that share an id the smallest vector
    does. Missing components at the end of a shorter vector count as 0. A quantised component beyond
    LARGEST counts as LARGEST; rows are ranked by their whole score, and a score that a long doesn't
    hold is shown as the nearest long. An empty table gives no rows; other columns are ignored.

    Rows are dealt into blocks by the hash of their id and each block is indexed in bit slices; blocks
    of queries meet every index block once, and the tops of the blocks are merged.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale, id_col, vector_col))
    size = F.aggregate("value", F.lit(0).cast("long"), lambda most, x: F.greatest(most, F.abs(x)))
    n, asked, largest, wide = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(size), F.max(F.size("value"))).first()
    fits = (largest or 0) ** 2 * (wide or 0) < 1 << 62  # else scores travel as decimals
    blocks, query_blocks = max(1, ceil(n / BLOCK_ROWS)), max(1, ceil(asked / BLOCK_QUERIES))
    shares = min(query_blocks, max(ceil(2 * spark.sparkContext.defaultParallelism / blocks), ceil(query_blocks / TASK_BLOCKS)))

    def index(table: pa.Table) -> pa.Table:
        packed = SlicedBlock.pack(table.column("vec_id").to_numpy(), _matrix(table.column("value")))
        return pa.table({"block": table.column("block").slice(0, 1), **{c: pa.array([x], pa.binary()) for c, x in zip(("ids", "low", "width", "maps"), packed, strict=True)}})

    def queries(table: pa.Table) -> pa.Table:
        values = _matrix(table.column("value"))
        return pa.table({"part": table.column("part").slice(0, 1), "names": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "weights": pa.array([values.tobytes()], pa.binary())})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for row in left.to_pylist():
            block = SlicedBlock.unpack(row["ids"], row["low"], row["width"], row["maps"])
            for part in right.to_pylist():
                names = np.frombuffer(part["names"], np.int64)
                weights = np.frombuffer(part["weights"], np.int64).reshape(len(names), -1)
                if weights.shape[1] != len(block.slices):
                    wide = np.zeros((len(names), len(block.slices)), np.int64)
                    shared = min(wide.shape[1], weights.shape[1])
                    wide[:, :shared] = weights[:, :shared]
                    weights = wide
                for own, query in zip(names.tolist(), weights, strict=True):
                    ids, score = block.top(query, own, k)
                    for column, found in zip(out, (np.full(len(ids), own), ids, score), strict=True):
                        column.append(found)
        ids = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out[:2]]
        score = pa.array(np.concatenate(out[2]).astype(np.int64) if out[2] else [], pa.int64()) if fits else pa.array([Decimal(int(x)) for part in out[2] for x in part], pa.decimal128(38, 0))
        return pa.table({"query_id": ids[0], "vec_id": ids[1], "score": score})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    indexed = dealt.groupBy("block").applyInArrow(index, "block int, ids binary, low binary, width binary, maps binary")
    asked_rows = rows.where(f"vec_id % {every} = 0").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"))
    parts = asked_rows.groupBy("part").applyInArrow(queries, "part int, names binary, weights binary")
    left = indexed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = parts.withColumn("share", F.col("part") % shares).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(search, f"query_id long, vec_id long, score {'long' if fits else 'decimal(38,0)'}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    shown = F.greatest(F.least(F.col("score"), F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", "score" if fits else shown.alias("score"))


#: The same in DuckDB, by plain inner products.
ORACLE_SQL = """
WITH rows_ AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows_ q JOIN rows_ c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
