"""Elias-Fano code of a monotone sequence: low bits packed, high bits in unary, sampled select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QBQQQ")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """About 2 + log2(largest / n) bits a value; ``select(i)`` reads a few bytes of the high bits only.

    Values are non-negative, not descending; repeats are fine, so is an empty sequence.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def build(cls, values) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        parts = [p.tobytes() for p in (self.low, self.high, self.samples)]
        return _HEAD.pack(self.n, self.width, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, width, a, b, c = _HEAD.unpack_from(data)
        at = _HEAD.size
        if len(data) != at + a + b + c:
            raise ValueError("truncated Elias-Fano block")
        return cls(n, width, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a),
                   np.frombuffer(data, np.uint32, c // 4, at + a + b))

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        first = i * self.width
        got = int.from_bytes(self.low[first // 8: (first + self.width + 7) // 8].tobytes(), "little")
        return (got >> (first % 8)) & ((1 << self.width) - 1)

    def _bit(self, i: int) -> int:
        """Place of one number ``i`` among the high bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        # Ones from the sampled bit on: skip whole bytes, then look into one.
        byte, skip = at // 8, at % 8
        ones = _ONES[self.high[byte: byte + 64]].astype(np.int64)
        ones[0] = _ONES[self.high[byte] >> skip]
        while True:
            total = np.cumsum(ones)
            if left < total[-1]:
                break
            left -= int(total[-1])
            byte, skip = byte + len(ones), 0
            ones = _ONES[self.high[byte: byte + 64]].astype(np.int64)
        hit = int(np.searchsorted(total, left, "right"))
        left -= int(total[hit - 1]) if hit else 0
        cell = int(self.high[byte + hit])
        start = skip if hit == 0 else 0
        for bit in range(start, 8):
            if cell >> bit & 1:
                if not left:
                    break
                left -= 1
        return (byte + hit) * 8 + bit

    def select(self, i: int) -> int:
        """Value number ``i``."""
        return (self._bit(i) - i) << self.width | self._low(i)

    def stretch(self, i: int, j: int) -> np.ndarray:
        """Values ``i`` to ``j - 1`` as unsigned 64-bit integers, from the bits that hold them alone."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = self._bit(i), self._bit(j - 1)
        byte = first // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte: last // 8 + 1], bitorder="little")) + byte * 8
        ones = ones[(ones >= first) & (ones <= last)]
        high = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.width)
        start = i * self.width
        bits = np.unpackbits(self.low[start // 8: (j * self.width + 7) // 8], bitorder="little")[start % 8:]
        bits = bits[: (j - i) * self.width].reshape(j - i, self.width).astype(np.uint64)
        return high | (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def reach(self, value: int, i: int, j: int) -> int:
        """The first of the numbers ``i`` to ``j`` whose value is larger, by bisection over ``select``; ``j`` if none is."""
        while i < j:
            middle = (i + j) // 2
            if self.select(middle) <= value:
                i = middle + 1
            else:
                j = middle
        return i
