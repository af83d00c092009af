"""Words and word shingles of whole texts as 64-bit hashes, over Arrow's own text buffers in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WIDTH = 5
_ODD_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Powers that a worker keeps (8 MB), and bytes of words that are hashed at once.
KNOWN_POWERS, RUN_BYTES = 1 << 19, 1 << 18
#: Bytes that part words: space and 0x09 to 0x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD_BASE))
PLACE = mix(np.arange(101, 101 + WIDTH, dtype=np.uint64)) | np.uint64(1)


def _product(base: int, n: int) -> np.ndarray:
    """Powers of a number modulo 2**64, from 0 to n - 1."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return _product(_ODD_BASE, KNOWN_POWERS), _product(pow(_ODD_BASE, -1, 1 << 64), KNOWN_POWERS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; a longer table than KNOWN_POWERS isn't kept."""
    return _powers() if n <= KNOWN_POWERS else (_product(_ODD_BASE, n), _product(pow(_ODD_BASE, -1, 1 << 64), n))


class Words:
    """The words of a batch of texts.

    ``first[d]`` to ``first[d + 1]`` are document d's words; ``start``, ``end`` are byte places in
    ``data``; ``hash`` depends on a word's bytes alone. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        size = len(self.data)
        inside = ~SPACE[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = self.bounds[:-1][np.diff(self.bounds) > 0]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[edge[1:] - 1] |= inside[edge[1:] - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.hash = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + RUN_BYTES, "right")))
            self.hash[at:to] = self._hashes(at, to, lower)
            at = to

    def _hashes(self, at: int, to: int, lower: bool) -> np.ndarray:
        """Hashes of some neighbouring words: their bytes' values by place, summed."""
        low, high = self.start[at], self.end[to - 1]
        data, start = self.data[low:high], self.start[at:to] - low
        length = self.end[at:to] - self.start[at:to]
        place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
        longest = int(length.max())
        value = BYTE_VALUES[LOWER[data] if lower else data]
        value[SPACE[data]] = 0
        value *= powers(longest)[0][np.minimum(place, longest - 1)]
        return mix(np.add.reduceat(value, start) + length.astype(np.uint64))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the window of WIDTH words from each word on, and whether its document has that many left."""
        h, n = self.hash, len(self.hash)
        out = np.zeros(n, np.uint64)
        full = max(0, n - WIDTH + 1)
        for k in range(WIDTH):
            out[:full] += h[k : k + full] * PLACE[k]
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        return mix(out + np.uint64(WIDTH)), left >= WIDTH

    def sets(self) -> Iterator[np.ndarray]:
        """Each document's set, as sorted distinct hashes: its shingles, or all its few words as one."""
        shingle, _ = self.windows()
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                yield distinct(shingle[a : b - WIDTH + 1])
            elif b > a:
                short = (self.hash[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def class_of(elements: np.ndarray) -> int:
    """A signed 64-bit number that stands for a whole set."""
    with np.errstate(over="ignore"):
        total = mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(elements))
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
