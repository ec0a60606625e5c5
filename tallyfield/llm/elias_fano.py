"""Elias-Fano coding of a non-decreasing sequence, with selection.

n values below u take about 2 + log2(u / n) bits each: the low bits are packed side by
side, the high parts are written in unary into a bit vector. Value i is found by
selecting the i-th one of that vector; a 32-bit count of ones per 512-bit block is the
only table.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512  # bits of the unary vector for each count


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(1, np.uint32))
        if n > 1 and (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        lows = (v & np.uint64((1 << low_bits) - 1)) if low_bits else np.zeros(n, np.uint64)
        bits = ((lows[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(places[-1]) + 1) // BLOCK) * BLOCK
        unary = np.zeros(size, np.uint8)
        unary[places] = 1
        ones = unary.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        counts = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), counts)

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions, reading one block of the vector for each."""
        index = np.asarray(index, np.int64)
        if len(index) and (index.min() < 0 or index.max() >= self.n):
            raise IndexError("position outside the sequence")
        out = np.empty(len(index), np.int64)
        block = np.searchsorted(self.counts, index, side="right") - 1
        for b in np.unique(block):
            at = block == b
            bits = np.unpackbits(self.high[b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
            places = np.flatnonzero(bits)[index[at] - int(self.counts[b])] + b * BLOCK
            out[at] = places - index[at]
        return (out << self.low_bits) | self._lows(index)

    def all(self) -> np.ndarray:
        index = np.arange(self.n)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((places - index) << self.low_bits) | self._lows(index)

    def _lows(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        for j in range(self.low_bits):
            bit = index * self.low_bits + j
            out |= ((self.low[bit >> 3].astype(np.int64) >> (bit & 7)) & 1) << j
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.counts)], "<u8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.counts.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = (int(x) for x in np.frombuffer(data, "<u8", 5))
        at = 40
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        counts = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, low_bits, low, high, counts)
