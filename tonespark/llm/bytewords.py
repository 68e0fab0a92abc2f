"""Pieces of whole text columns as spans of UTF-8 bytes, and 64-bit keys of them, without a Python string for each piece.

Keys are polynomial sums of a span's bytes, mixed; two different pieces share a
key with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: ASCII capitals to small letters, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that the words of this subpackage are separated by.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POWERS["up"])
    if have < n:
        n = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and where each text begins (one entry more than texts). Null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1_000_000):
    """Ranges of consecutive texts of `most` bytes at most; a longer text comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def parts(column: pa.Array, most: int = 1_000_000):
    """(first, end) of slices of a string column of `most` bytes at most; a longer text comes alone."""
    return slices(text_bytes(column)[1], most)


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no gaps, never across texts, and how many each text has."""
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Key of each span of data."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Known:
    """A growing set of 64-bit keys, numbered in the order in which they came, in an open-addressed table."""

    def __init__(self):
        self.n, self.bits = 0, 16
        self._fresh()

    def _fresh(self) -> None:
        self.slots, self.numbers = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _home(self, k: np.ndarray) -> np.ndarray:
        return ((k * BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown."""
        slot, mask = self._home(k), (1 << self.bits) - 1
        out = np.full(len(k), -1, np.int64)
        todo = np.arange(len(k))
        while len(todo):
            number = self.numbers[slot]
            hit = (self.slots[slot] == k[todo]) & (number >= 0)
            out[todo[hit]] = number[hit]
            on = ~hit & (number >= 0)
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def add(self, k: np.ndarray) -> None:
        """Add distinct keys that are not known; they get the next numbers."""
        if 2 * (self.n + len(k)) > 1 << self.bits:
            old, numbers = self.slots[self.numbers >= 0], self.numbers[self.numbers >= 0]
            while 2 * (self.n + len(k)) > 1 << self.bits:
                self.bits += 1
            self._fresh()
            self._put(old, numbers)
        self._put(k, np.arange(self.n, self.n + len(k), dtype=np.int32))
        self.n += len(k)

    def _put(self, k: np.ndarray, numbers: np.ndarray) -> None:
        slot, mask = self._home(k), (1 << self.bits) - 1
        todo = np.arange(len(k))
        while len(todo):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = numbers[todo[free]]  # of several keys for one slot the last wins
            self.slots[slot[free]] = k[todo[free]]
            lost = (self.slots[slot] != k[todo]) | (self.numbers[slot] != numbers[todo])
            todo, slot = todo[lost], (slot[lost] + 1) & mask


def distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the number of every key among them."""
    if not len(k):
        return k, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(k)
    ranked = k[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse
