"""Near-duplicate lines by a segment-partition edit join.

Lines within EDITS edits of each other, cut into EDITS + 1 segments, share one: a line's segments are
indexed under its length, and every line probes the substrings that a partner's segments may equal.
Lines that meet in a list are verified by banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import Output, Seen, small_batches, slices, tidy, tidy_table
from lodestone.llm.shared import removed, written
from lodestone.llm.shingles import mix, powers

#: Edits (insertions, deletions, substitutions of a character) that still make a near duplicate, and
#: the characters from which a line takes part in the edit join: segments of four at least. Two edits
#: turn shorter lines into other words. Exact copies of shorter lines are found with ``every_line``.
EDITS, LEAST_CHARS = 2, 12
#: Bits of the filter that picks the texts of lines that met another: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: Keys of one bucket, characters of one verifying task, lines of one block of a large group, about.
BUCKET_KEYS, TASK_CHARS, BLOCK_LINES = 300_000, 2_000_000, 1_024
#: Characters of lines that are hashed together, and keys that a task deals at once.
PIECE_CHARS, FLUSH_KEYS = 1 << 18, 1 << 18
_BINS = 16
#: What tells the place of a line, in the order of places.
_PLACE = ("doc_id", "text_hash", "line_no")


class Lines:
    """Some lines that take part: texts, their document's row in a batch, number and hashes."""

    def __init__(self, text: list[str], row: list[int], number: list[int]):
        self.text, self.row, self.number = text, row, number
        self.length = np.array([len(x) for x in self.text], np.int64)
        self.start = np.cumsum(self.length) - self.length
        codes = np.frombuffer("".join(self.text).encode("utf-32-le", "surrogatepass"), np.uint32)
        up, self.down = powers(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        value = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)
        np.cumsum(value * up[: len(codes)], out=self.total[1:])
        self.hash = self.part(self.start, self.length, 0, 99).view(np.int64)

    @classmethod
    def of(cls, texts: list[str | None], every_line: bool = False) -> Iterator[Lines]:
        """The lines of texts, PIECE_CHARS characters at a time; a longer line comes alone.

        Lines of LEAST_CHARS characters or more take part, with ``every_line`` all that aren't blank too.
        """
        text, row, number, held = [], [], [], 0
        for at, whole in enumerate(texts):
            for k, line in enumerate((whole or "").split("\n")):
                if len(line) >= LEAST_CHARS or every_line and line.strip():
                    if text and held + len(line) > PIECE_CHARS:
                        yield cls(text, row, number)
                        text, row, number, held = [], [], [], 0
                    text.append(line)
                    row.append(at)
                    number.append(k)
                    held += len(line)
        if text:
            yield cls(text, row, number)

    def part(self, at: np.ndarray, size: np.ndarray, length: np.ndarray | int, kind: int) -> np.ndarray:
        """Hashes of the substrings at these places, told apart by a length and a kind."""
        body = (self.total[at + size] - self.total[at]) * self.down[at]
        return mix(mix(body + size.astype(np.uint64)) + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.asarray(length).astype(np.uint64))

    def keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and probe keys of some of the lines, and the row of each.

        A probe of a partner that is ``d`` shorter tries, for segment i, only the places that leave
        few enough edits to the left and to the right of it.
        """
        start, length, parts = self.start[rows], self.length[rows], EDITS + 1
        keys, owners = [], []
        for d in range(EDITS + 1):
            partner = length - d
            own = partner >= LEAST_CHARS
            for i in range(parts):
                begin, end = i * partner // parts, (i + 1) * partner // parts
                for shift in range(max(-i, d - (EDITS - i)), min(i, d + (EDITS - i)) + 1):
                    at = begin + shift
                    fits = own & (at >= 0) & (at + (end - begin) <= length)
                    keys.append(self.part(start[fits] + at[fits], (end - begin)[fits], partner[fits], i + 1))
                    owners.append(rows[fits])
        return np.concatenate(keys), np.concatenate(owners)


def edit_distances(a: list[str], b: list[str], edits: int = EDITS) -> np.ndarray:
    """For each pair its edit distance if that is at most ``edits``, else a larger number.

    Bit k of a vector is the row k - edits away from the diagonal, so that the band moves down one
    row with each column; all pairs of a batch move together. The distance is followed along the
    diagonal that ends in the last cell: it grows by one wherever the diagonal step isn't free.
    """
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(len(a), edits + 1, np.int64)
    order = np.flatnonzero(np.abs(n_a - n_b) <= edits)
    order = order[np.argsort(n_b[order], kind="stable")]
    one, band = np.uint64(1), 2 * edits + 1
    at = 0
    while at < len(order):
        rows = order[at : at + max(1, 2_000_000 // (int(n_b[order[min(at + 4_095, len(order) - 1)]]) + 1))][:4_096]
        at += len(rows)
        wide = int(n_b[rows].max()) if len(rows) else 0
        left = np.full((wide + band + edits + 1, len(rows)), 0xFFFFFFFF, np.uint32)
        right = np.full((wide + 1, len(rows)), 0xFFFFFFFE, np.uint32)
        for k, r in enumerate(rows.tolist()):
            left[edits : edits + n_a[r], k] = np.frombuffer(a[r].encode("utf-32-le", "surrogatepass"), np.uint32)
            right[: n_b[r], k] = np.frombuffer(b[r].encode("utf-32-le", "surrogatepass"), np.uint32)
        more = np.full(len(rows), ~np.uint64(0) << np.uint64(edits))
        less = np.zeros(len(rows), np.uint64)
        goal = (n_a[rows] - n_b[rows] + edits).astype(np.uint64)
        distance = np.maximum(n_a[rows] - n_b[rows], 0)
        for j in range(wide):
            match = np.zeros(len(rows), np.uint64)
            for k in range(band):
                match |= (left[j + k] == right[j]).astype(np.uint64) << np.uint64(k)
            free = (((match & more) + more) ^ more) | match | less
            up, down = less | ~(free | more), free & more
            distance += ((free >> goal & one) == 0) & (j < n_b[rows])
            free >>= one
            more, less = down | ~(free | up), free & up
        out[rows] = np.minimum(distance, edits + 1)
    return out


def earliest_near(lines: list[str], earlier: list[bool] | None = None) -> list[int]:
    """For each line the first line before it within EDITS edits, or -1; lines stand in their order.

    With ``earlier``, only pairs of a line marked so and one not marked are looked at. Lengths and
    counts of characters rule out most pairs at once; the rest are verified in order, some at a time.
    """
    n = len(lines)
    length = np.array([len(x) for x in lines], np.int64)
    bins = np.zeros((n, _BINS), np.int32)
    for k, line in enumerate(lines):
        bins[k] = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % _BINS, minlength=_BINS)
    side = np.array(earlier) if earlier is not None else None
    waiting: dict[int, np.ndarray] = {}
    for k in range(1, n):
        may = np.flatnonzero(np.abs(length[:k] - length[k]) <= EDITS)
        if side is not None:
            may = may[side[may] != side[k]]
        may = may[np.abs(bins[may] - bins[k]).sum(axis=1) <= 2 * EDITS]
        if len(may):
            waiting[k] = may
    found, size = [-1] * n, 1
    while waiting:
        pairs = [(k, int(o)) for k, may in waiting.items() for o in may[:size]]
        near = edit_distances([lines[k] for k, _ in pairs], [lines[o] for _, o in pairs]) <= EDITS
        for (k, other), hit in zip(pairs, near.tolist(), strict=True):
            if hit and found[k] < 0:
                found[k] = other
        waiting = {k: may[size:] for k, may in waiting.items() if found[k] < 0 and len(may) > size}
        size *= 4
    return found


def _occurrences(docs: DataFrame, every_line: bool) -> DataFrame:
    """Every line that takes part: h, doc_id, text_hash (of the whole text), line_no."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line_no", pa.int32())])

    def run(batches):
        for batch in slices(batches):
            for lines in Lines.of(batch.column(1).to_pylist(), every_line):
                row = pa.array(lines.row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash), batch.column(0).take(row), batch.column(2).take(row), pa.array(lines.number, pa.int32())], schema=schema)

    return docs.mapInArrow(tidy(run), "h long, doc_id long, text_hash long, line_no int")


def _new_lines(batches) -> Iterator[tuple[Lines, np.ndarray]]:
    """The lines of each batch that can be near another, and which of them this task hasn't seen of late."""
    seen = Seen()
    for batch in slices(batches):
        for lines in Lines.of(batch.column(1).to_pylist()):
            rows = [row for row, h in enumerate(lines.hash.tolist()) if seen.new(h)]
            if rows:
                yield lines, np.array(rows, np.int64)


def _keys(docs: DataFrame, buckets: int) -> DataFrame:
    """Keys of distinct lines, packed by bucket: 32 bits of the key (the bucket has the others) and the line's hash."""
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def packed(out, keys, hashes):
        key, h = np.concatenate(keys), np.concatenate(hashes)
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        key, h = key[by].astype(np.uint32), h[by]
        begin = 0
        for b, end in enumerate(np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()):
            if end > begin:
                data = key[begin:end].tobytes() + h[begin:end].tobytes()
                if out.add(b, data, size=len(data)):
                    yield out.batch()
            begin = end

    def run(batches):
        out, keys, hashes, held = Output(schema), [], [], 0
        for lines, rows in _new_lines(batches):
            key, owner = lines.keys(rows)
            keys.append(key)
            hashes.append(lines.hash[owner])
            held += len(key)
            if held >= FLUSH_KEYS:
                yield from packed(out, keys, hashes)
                keys, hashes, held = [], [], 0
        if keys:
            yield from packed(out, keys, hashes)
        yield out.batch()

    return docs.mapInArrow(tidy(run), "bucket int, data binary")


def _meetings(keys: DataFrame) -> DataFrame:
    """Lines that share a key: grp (the least hash of the list) and h."""

    def of_bucket(table: pa.Table) -> pa.Table:
        key, h = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for data in table.column("data").to_pylist():
            n = len(data) // 12
            key.append(np.frombuffer(data, np.uint32, n))
            h.append(np.frombuffer(data, np.int64, n, 4 * n))
        key, h = np.concatenate(key), np.concatenate(h)
        by = np.argsort(key, kind="stable")
        key, h = key[by], h[by]
        shared = np.zeros(len(key), bool)
        shared[1:] = (key[1:] == key[:-1]) & (h[1:] != h[:-1])
        mixed = np.isin(key, key[shared])  # keys with two different lines
        key, h = key[mixed], h[mixed]
        by = np.lexsort((h, key))
        key, h = key[by], h[by]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        least = np.repeat(h[at], np.diff(np.append(at, len(key))))
        pairs = np.unique(np.stack([least, h], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        return pa.table({"grp": pairs[:, 0], "h": pairs[:, 1]})

    return keys.groupBy("bucket").applyInArrow(tidy_table(of_bucket), "grp long, h long").distinct()


def _filter_of(meetings: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS over the hashes of lines that met another."""
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = meetings.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    whole = bytearray(FILTER_BITS // 8)
    for row in rows:
        at = (row["part"] - 1) * len(row["bits"])
        whole[at : at + len(row["bits"])] = row["bits"]
    return bytes(whole)


def _texts(docs: DataFrame, bits: bytes) -> DataFrame:
    """The texts of lines that the filter holds, once in each task: h, line."""
    schema = pa.schema([("h", pa.int64()), ("line", pa.string())])

    def run(batches):
        held = np.frombuffer(bits, np.uint8)
        for lines, rows in _new_lines(batches):
            place = lines.hash[rows] & (FILTER_BITS - 1)
            rows = rows[held[place >> 3] >> (place & 7) & 1 == 1]
            yield pa.RecordBatch.from_arrays([pa.array(lines.hash[rows]), pa.array([lines.text[r] for r in rows.tolist()], pa.string())], schema=schema)

    return docs.mapInArrow(tidy(run), "h long, line string")


def _near(members: DataFrame) -> DataFrame:
    """Each line's first earlier near duplicate in a group: h, like (its place)."""

    def of_task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("grp", "i", "j", "doc_id", "text_hash", "line_no", "h")])
        grp, i, j, block, h = (table.column(c).to_numpy() for c in ("grp", "i", "j", "block", "h"))
        new = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(grp) else []
        here, there = [], []
        for a, b in zip(new, [*new[1:], len(grp)], strict=True):
            if b - a > 1:
                line = table.column("line").slice(a, b - a).to_pylist()
                for k, other in enumerate(earliest_near(line, (block[a:b] == i[a]).tolist() if i[a] != j[a] else None)):
                    if other >= 0:
                        here.append(a + k)
                        there.append(a + other)
        like = table.select(list(_PLACE)).take(pa.array(there, pa.int64()))
        return pa.table({"h": pa.array(h[np.array(here, np.int64)]), **{f"like_{c}": like.column(c) for c in _PLACE}})

    return members.groupBy("task").applyInArrow(tidy_table(of_task), "h long, like_doc_id long, like_text_hash long, like_line_no int")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_line: bool = False) -> DataFrame:
    """Lines to remove: doc_id, line_no (from 0, between \\n), like_doc, like_line, edits_apart (boolean) and text_hash.

    Lines of at least LEAST_CHARS characters take part; with ``every_line`` exact copies of shorter
    ones go too, blank ones apart. Distinct lines stand in the order of their first place (doc_id,
    text_hash, line_no). A line of LEAST_CHARS characters or more within EDITS edits of such an
    earlier distinct line goes everywhere (edits_apart; like_* is the first such line's place); of
    another line all but the first place goes. text_hash is xxhash64 of the row's whole text: rows
    that share a doc_id, or have none, are told apart by it, and only exactly repeated rows count as
    the same places and all keep the line. A null doc_id comes first. Null and empty texts and empty
    tables have no lines; other columns are ignored. Lines are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs[text_col].cast("string")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    places = written(_occurrences(docs, every_line))
    first = written(places.groupBy("h").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, ceil(first.count() * 15 / BUCKET_KEYS))
    met = written(_meetings(_keys(docs, buckets)))

    texts = _texts(docs, _filter_of(met)).groupBy("h").agg(F.first("line").alias("line")).join(first, "h")
    sizes = met.groupBy("grp").agg(F.count("*").alias("k")).select("grp", F.ceil(F.col("k") / BLOCK_LINES).cast("int").alias("blocks"))
    members = met.join(sizes, "grp").join(texts, "h").select("grp", "h", "line", "first.*", "blocks", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = members.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = max(partitions, ceil(met.count() * 200 / TASK_CHARS))
    dealt = paired.select(F.pmod(F.xxhash64("grp", "i", "j"), F.lit(tasks)).cast("int").alias("task"), "grp", "i", "j", "block", "h", *_PLACE, "line")
    near = _near(dealt.repartition(min(tasks, 8 * partitions), "task")).groupBy("h").agg(F.min(F.struct(*(f"like_{c}" for c in _PLACE))).alias("like"))

    fate = written(first.join(near, "h", "left").where("like is not null or n > 1").select("h", "first", "like"))
    removed(met)
    here = F.struct(*_PLACE)
    judged = places.join(fate, "h").where(F.col("like").isNotNull() | ~F.col("first").eqNullSafe(here))
    near_one = F.col("like").isNotNull()
    return judged.select("doc_id", "line_no", F.when(near_one, F.col("like.like_doc_id")).otherwise(F.col("first.doc_id")).alias("like_doc"), F.when(near_one, F.col("like.like_line_no")).otherwise(F.col("first.line_no")).alias("like_line"), near_one.alias("edits_apart"), "text_hash")


def without_duplicate_lines(docs: DataFrame, every_line: bool = False) -> DataFrame:
    """Documents without the lines that ``duplicate_lines`` names; all other lines and columns stay.

    Lines go from rows of that doc_id and text alone. n_chars, where there is one, follows the text.
    A document of which nothing but white space is left, though it had more before, goes: all its
    lines stand elsewhere. Null and empty texts stay as they are.
    """
    gone = duplicate_lines(docs, every_line=every_line).groupBy(F.col("doc_id").alias("id__gone"), F.col("text_hash").alias("hash__gone")).agg(F.collect_set("line_no").alias("lines__gone"))
    joined = docs.join(gone, docs.doc_id.cast("long").eqNullSafe(F.col("id__gone")) & (F.xxhash64(docs.text.cast("string")) == F.col("hash__gone")), "left")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(x.alias("line"), k.alias("k")))
    kept = F.filter(numbered, lambda x: ~F.array_contains("lines__gone", x["k"]))
    text = F.when(F.col("lines__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    out = joined.withColumn("text", text).where("lines__gone is null or text rlike '\\\\S'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(docs.columns)
