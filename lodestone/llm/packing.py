"""Packing of documents into windows of a fixed number of tokens by best-fit decreasing."""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import Output, columns_of, rows_of, tidy, tidy_table
from lodestone.llm.shared import written
from lodestone.llm.tokens import encoder

#: Tails that one block packs together, and the bytes of ids that it may hold.
BLOCK_TAILS, BLOCK_BYTES = 20_000, 24 << 20
#: Sequence ids of one task begin at the task's partition number times TASK_STRIDE, those of a group
#: of pieces that are packed anew at REPACKED and the group's number times GROUP_STRIDE.
TASK_STRIDE, REPACKED, GROUP_STRIDE = 1 << 40, 1 << 62, 1 << 24
#: A window with more room than its capacity by this is open: its pieces are packed anew with those of other tasks.
OPEN_SHARE = 64


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of counts.

    A leaf stands for one remaining capacity and an inner node for the sum of its two halves, so
    the tightest window that still has room is found in a logarithm of the capacity.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.at[room].append(window)
            self._change(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove the window with the least room for ``length``: its room and its number."""
        count, node = self.count, length + self.leaves
        if not count[node]:
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """The window and the offset of each piece; pieces of equal length go in their given order."""
    windows, placed, used = OpenWindows(capacity), [(0, 0)] * len(lengths), 0
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = windows.take(lengths[piece])
        if found is None:
            found, used = (capacity, used), used + 1
        room, window = found
        placed[piece] = (window, capacity - room)
        windows.put(room - lengths[piece], window)
    return placed


#: A piece, its ids, and whether its window has more room than a share of OPEN_SHARE.
PIECE = "doc_id long, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary, open boolean"
SCHEMA = pa.schema([*((c, pa.int64()) for c in ("doc_id", "doc_tokens", "start", "length", "sequence_id", "offset")), ("ids", pa.binary()), ("open", pa.bool_())])


def _dealt(docs: DataFrame, tokenizer: str, window: int, terminator: int) -> DataFrame:
    """Each task's own packing of what it reads, in blocks of bounded size, numbered from its partition number on."""

    def run(batches):
        encode, out = encoder(tokenizer).encode, Output(SCHEMA)
        end, width = terminator.to_bytes(4, "little"), 4 * window
        sequence = TaskContext.get().partitionId() * TASK_STRIDE
        tails: list[tuple] = []
        held = 0

        def block():
            nonlocal sequence
            lengths = [len(tail[3]) // 4 for tail in tails]
            placed = best_fit_decreasing(lengths, window)
            used = [0] * (1 + max((number for number, _ in placed), default=-1))
            for (number, _), length in zip(placed, lengths, strict=True):
                used[number] += length
            for (doc_id, n, start, ids), (number, offset), length in zip(tails, placed, lengths, strict=True):
                if out.add(doc_id, n, start, length, sequence + number, offset, ids, OPEN_SHARE * (window - used[number]) > window, size=len(ids)):
                    yield out.batch()
            sequence += len(used)
            tails.clear()

        for doc_id, text in rows_of(batches):
            ids = encode(text or "") + end
            n, full = len(ids) // 4, len(ids) // width
            for k in range(full):
                if out.add(doc_id, n, k * window, window, sequence, 0, ids[k * width : (k + 1) * width], False, size=width):
                    yield out.batch()
                sequence += 1
            if tail := ids[full * width :]:
                tails.append((doc_id, n, full * window, tail))
                held += len(tail)
                if len(tails) >= BLOCK_TAILS or held >= BLOCK_BYTES:
                    yield from block()
                    held = 0
        yield from block()
        yield out.batch()

    return docs.mapInArrow(tidy(run), PIECE)


def _met(opened: DataFrame, groups: int, window: int) -> DataFrame:
    """Pieces of open windows, packed anew in groups: sequence_id, offset, and those that take their place."""

    def of_group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        first = REPACKED + table.column("grp")[0].as_py() * GROUP_STRIDE
        placed = best_fit_decreasing(table.column("length").to_pylist(), window)
        return pa.table({"sequence_id": table.column("sequence_id"), "offset": table.column("offset"), "new_sequence": pa.array([first + number for number, _ in placed], pa.int64()), "new_offset": pa.array([offset for _, offset in placed], pa.int64())})

    grp = F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)).alias("grp")
    return opened.select("sequence_id", "offset", "length", grp).groupBy("grp").applyInArrow(tidy_table(of_group), "sequence_id long, offset long, new_sequence long, new_offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, terminator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents, packed into sequences of at most ``window`` tokens.

    A document is its token ids and then ``terminator``; one that is longer than a window is first
    cut into full windows, and what is left over, its tail, is packed by best-fit decreasing. Rows:
    doc_id, doc_tokens, start, length, sequence_id, offset and ids (little-endian unsigned 32-bit).

    A task packs the tails that it reads, in blocks, and numbers sequences from its own partition
    number, so that a repeated task gives whole sequences again. The tails of windows that stay open
    are dealt into groups of about BLOCK_TAILS by a hash and packed again, so that padding doesn't
    depend on how the documents are dealt out; only those pieces are shuffled. All pieces are written
    in between to the shared folder.

    A null or empty text is the terminator alone. Repeated rows are packed each. Ties of length go
    in the order of the rows. An empty table gives no pieces. Other columns are ignored.
    """
    source = columns_of(docs, id_col, text_col)
    pieces = written(_dealt(source.select(source.doc_id.cast("long"), "text"), tokenizer, window, terminator))
    columns = [c for c in pieces.columns if c != "open"]
    opened = pieces.where("open")
    n = opened.count()
    if not n:
        return pieces.select(columns)
    new = _met(opened, ceil(n / BLOCK_TAILS), window)
    moved = opened.join(new, ["sequence_id", "offset"]).withColumn("sequence_id", F.col("new_sequence")).withColumn("offset", F.col("new_offset"))
    return pieces.where("not open").select(columns).unionByName(moved.select(columns))
