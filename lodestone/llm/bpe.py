"""Byte-level BPE over a rank file: encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.arrow import columns_of, rows_of, tidy
from lodestone.llm.tokens import _ODD, _SPLIT, safe_pieces

#: Rows and bytes of ids of one output batch.
OUT_ROWS, OUT_BYTES = 1000, 4 << 20
#: Entries of the pre-token memo, about 200 bytes each; a full memo is emptied.
MEMO_ENTRIES = 900_000


class Merger:
    """Merges the bytes of one pre-token, least rank first and from the left.

    Waiting pairs stand in a rank queue: two levels of 256-way bitmaps over one bucket of positions
    per rank. A set bit above tells that the word below has one, so that two find-first-set steps
    give the least rank. A bucket is one position, or a heap of them; an entry whose pair has
    changed since is stale and skipped. All bitmaps are empty again when a pre-token is done. The
    cost is n log n, for pre-tokens of any length.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.bit = [1 << b for b in range(max(256, len(self.low)))]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a pre-token. The queue's steps stand inline, as calls would cost more than they do."""
        rank_of, low, bit, bucket, top = self.ranks.get, self.low, self.bit, {}, 0
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # starts of the neighbours' tokens
        pair: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # the rank of a token with the next one
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in bucket:
                    waiting = bucket[rank]
                    if type(waiting) is list:
                        waiting.append(i)
                    else:
                        bucket[rank] = [waiting, i]
                else:
                    bucket[rank] = i
                    low[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        live = n - pair.count(None)  # pairs that still can merge; the rest of the queue is stale
        while live:
            above = (top & -top).bit_length() - 1
            word = low[above]
            rank = above << 8 | (word & -word).bit_length() - 1
            i = waiting = bucket[rank]
            if type(waiting) is list:
                i = heappop(waiting)
            if i is waiting or not waiting:
                del bucket[rank]
                low[above] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            if pair[gone] is not None:
                pair[gone] = None
                live -= 1
            if end < n:
                before[end] = i
                new = pair[i] = rank_of(piece[i : after[end]])
                if new is not None:
                    if new in bucket:
                        waiting = bucket[new]
                        bucket[new] = waiting = waiting if type(waiting) is list else [waiting]
                        heappush(waiting, i)
                    else:
                        bucket[new] = i
                        low[new >> 8] |= bit[new & 255]
                        top |= bit[new >> 8]
                else:
                    live -= 1
            else:
                pair[i] = None
                live -= 1
            left = before[i]
            if left >= 0:
                new, old = rank_of(piece[left:end]), pair[left]
                pair[left] = new
                if new is not None:
                    if old is None:
                        live += 1
                    if new in bucket:
                        waiting = bucket[new]
                        bucket[new] = waiting = waiting if type(waiting) is list else [waiting]
                        heappush(waiting, left)
                    else:
                        bucket[new] = left
                        low[new >> 8] |= bit[new & 255]
                        top |= bit[new >> 8]
                elif old is not None:
                    live -= 1
        for rank in bucket:
            low[rank >> 8] = 0
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids


class Codec:
    """Whole texts to little-endian 32-bit ids and ids back to bytes, with a memo of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.length = np.full(max(self.ranks.values(), default=0) + 1, -1, np.int64)
        for token, rank in self.ranks.items():
            self.length[rank] = len(token)
        self.data = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.__getitem__)), np.uint8)
        self.begin = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        self.merger = Merger(self.ranks)
        known = pattern == PATTERN
        unicode_spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split_any = regex.compile(unicode_spaces)
        self.plain = _SPLIT if known else None
        self.memo: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.plain is not None and not _ODD.search(text):
            return self.plain.findall(text)
        return [match.group() for match in self.split_any.finditer(text)]

    def encode(self, text: str) -> bytes:
        memo, out = self.memo, []
        for piece in safe_pieces(text) if self.plain is not None else [text]:
            words = self.words(piece)
            parts = list(map(memo.get, words))
            if None in parts:
                if len(memo) > MEMO_ENTRIES:
                    memo.clear()
                for word in set(words).difference(memo):
                    memo[word] = array("i", self.merger.encode(word.encode())).tobytes()
                parts = list(map(memo.__getitem__, words))
            out.append(b"".join(parts))
        return b"".join(out)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many texts, and where each ends, from their ids and where those end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or self.length[ids].min() < 0):
            raise ValueError("an id that the ranks don't have")
        length = self.length[ids]
        at = np.cumsum(length)
        step = np.repeat(self.begin[ids] - at + length, length)
        step += np.arange(len(step))
        return self.data[step], np.concatenate([[0], at])[ends]


#: The split of byte-level BPE that ``plain`` is written for (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, ranks: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as token ids: doc_id, ids (array of int).

    Every match of ``pattern`` is encoded by itself, without special tokens. A null or empty text
    has no ids. Repeated rows are encoded each; an empty table gives no rows; other columns are
    ignored. One narrow pass; a task holds one batch and the memo.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def batch(names, parts):
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids], schema=schema)

    def run(batches):
        encode, names, parts, held = codec(ranks, pattern).encode, [], [], 0
        for doc_id, text in rows_of(batches):
            names.append(doc_id)
            parts.append(encode(text or ""))
            held += len(parts[-1])
            if len(parts) >= OUT_ROWS or held >= OUT_BYTES:
                yield batch(names, parts)
                names, parts, held = [], [], 0
        yield batch(names, parts)

    source = columns_of(docs, id_col, text_col)
    return source.select(source.doc_id.cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """Token ids back to bytes: doc_id, ids, decoded (binary). A null list gives null; an unknown id fails."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        decode = codec(ranks, pattern).decode
        for batch in batches:
            rows = batch.column(1)
            known = rows.drop_null() if rows.null_count else rows
            at = known.offsets.to_numpy()
            data, ends = decode(known.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0])
            decoded = pa.Array.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            if rows.null_count:
                valid = rows.is_valid().to_numpy(zero_copy_only=False)
                decoded = decoded.take(pa.array(np.cumsum(valid) - 1, mask=~valid))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows.cast(schema.field(1).type), decoded], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded binary")
