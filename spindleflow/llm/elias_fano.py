"""Elias-Fano sequences over numpy arrays, for queries in batches."""

from __future__ import annotations

import numpy as np

# Place of the r-th set bit of a byte (8 where it has fewer).
_SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _rank, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _SELECT[_byte, _rank] = _bit


def _select(words: np.ndarray, ranks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of the bit of each rank (from 0) in each 64-bit word."""
    parts = words.view(np.uint8).reshape(-1, 8)
    reach = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
    byte = np.minimum((reach <= ranks[:, None]).sum(axis=1), 7)
    rows = np.arange(len(words))
    before = np.where(byte > 0, reach[rows, byte - 1], 0)
    return byte * 8 + table[parts[rows, byte], np.minimum(ranks - before, 7)]


class EliasFano:
    """A sequence of n numbers that never falls, below ``universe``: about 2 + log2(universe / n) bits each.

    High parts are written in unary (number i sets bit high + i), low parts packed in 64-bit words. A directory counts
    the set bits before each word. ``arrays`` are all there is: they may lie in a memory-mapped file.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.size, self.width, self.buckets = (int(x) for x in arrays["shape"])
        self.high, self.low, self.ones = arrays["high"], arrays["low"], arrays["ones"]
        self.table = _SELECT

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, int(np.floor(np.log2(max(1, universe) / n)))) if n else 0
        highs = (values >> np.uint64(width)).astype(np.int64)
        buckets = (max(0, int(universe) - 1) >> width) + 1
        places = highs + np.arange(n)
        bits = np.zeros(-(-(n + buckets) // 64) * 64, bool)
        bits[places] = True
        high = np.packbits(bits, bitorder="little").view("<u8")
        low = np.zeros(-(-n * width // 64) + 1, np.uint64)
        if width:
            rest = values & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {"shape": np.array([n, width, buckets], np.int64), "high": high, "low": low, "ones": ones}

    def _low(self, places: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(places), np.uint64)
        at = places * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = (at & 63) + self.width > 64
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.width) - 1)

    def get(self, places: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        word = np.searchsorted(self.ones, places, "right") - 1
        bit = word * 64 + _select(np.ascontiguousarray(self.high[word]), places - self.ones[word], self.table)
        return (bit - places) << self.width | self._low(places).astype(np.int64)

    def before_bucket(self, buckets: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below each bucket (the zeros of the unary part end the buckets)."""
        out = np.zeros(len(buckets), np.int64)
        inside = np.flatnonzero(buckets > 0)
        rank = buckets[inside] - 1  # the zero that ends the bucket before
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(zeros, rank, "right") - 1
        bit = word * 64 + _select(~self.high[word], rank - zeros[word], self.table)
        out[inside] = bit - rank
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value, or -1: a successor search within the bucket of the value's high part."""
        out = np.full(len(values), -1, np.int64)
        if not self.size or not len(values):
            return out
        bucket = values >> self.width
        at, end = self.before_bucket(bucket), self.before_bucket(bucket + 1)
        low = (values & ((1 << self.width) - 1)).astype(np.uint64)
        live = np.flatnonzero(at < end)
        while len(live):
            here = self._low(at[live])
            out[live[here == low[live]]] = at[live[here == low[live]]]
            live = live[here < low[live]]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out
