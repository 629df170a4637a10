"""Elias-Fano sequences in numpy: monotone numbers as packed low bits and a bit vector of high parts."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the kth zero bit of a byte, least bit first; 8 if there is none.
_ZERO = np.array([[next((i for i in range(8) if not b >> i & 1 and sum(not b >> j & 1 for j in range(i)) == k), 8) for k in range(8)] for b in range(256)], np.uint8)

#: Place of the kth one bit of a byte.
_ONE = np.array([_ZERO[255 - b] for b in range(256)], np.uint8)


class EliasFano:
    """A sequence of n rising numbers; access by place, and the place of a number."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        zeros = 8 - _ONES[high].astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])
        self.ones = np.arange(len(self.zeros)) * 8 - self.zeros

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values, n = values.astype(U), len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        parts = values & U((1 << bits) - 1)
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        for a in range(0, n, 1 << 16):  # runs of whole bytes
            some = parts[a : a + (1 << 16)]
            flags = (some[:, None] >> np.arange(bits, dtype=U) & U(1)).astype(np.uint8)
            packed = np.packbits(flags.ravel(), bitorder="little")
            low[a * bits // 8 : a * bits // 8 + len(packed)] = packed
        upper = (values >> U(bits)).astype(np.int64)
        marks = np.zeros(n + (int(upper[-1]) if n else 0) + 2, np.uint8)
        marks[upper + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little"))

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at.astype(np.int64) * self.bits
        byte, out = bit >> 3, np.zeros(len(at), U)
        for k in range((self.bits + 14) // 8):
            if k < 8:
                out |= self.low[byte + k].astype(U) << U(8 * k)
        return out >> (bit & 7).astype(U) & U((1 << self.bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(self.zeros, k, "right") - 1
        inside = byte < len(self.high)
        byte = np.minimum(byte, len(self.high) - 1)
        return np.where(inside, byte * 8 + _ZERO[self.high[byte], np.minimum(k - self.zeros[byte], 7)], len(self.high) * 8)

    def _below(self, upper: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller high part."""
        out = np.where(upper > 0, self._select0(np.maximum(upper - 1, 0)) - np.maximum(upper - 1, 0), 0)
        return np.minimum(out, self.n)

    def at(self, place: np.ndarray) -> np.ndarray:
        """The numbers at the places."""
        byte = np.searchsorted(self.ones, place, "right") - 1
        high = byte * 8 + _ONE[self.high[byte], place - self.ones[byte]] - place
        return high.astype(U) << U(self.bits) | self._low(place)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Place of each number, -1 where it is not in the sequence, or not from place begin on and before place stop."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(U)
        upper, part = (x >> U(self.bits)).astype(np.int64), x & U((1 << self.bits) - 1)
        most = len(self.high) * 8 - self.n
        at, end = self._below(np.minimum(upper, most)), self._below(np.minimum(upper + 1, most))
        if begin is not None:
            at, end = np.maximum(at, begin), np.minimum(end, stop)
        # Numbers with one high part lie together in order: halve their range until it is a single place.
        stop, live = end.copy(), np.flatnonzero((at < end) & (upper < most))
        while len(live):
            middle = (at[live] + stop[live]) >> 1
            less = self._low(middle) < part[live]
            at[live] = np.where(less, middle + 1, at[live])
            stop[live] = np.where(less, stop[live], middle)
            live = live[at[live] < stop[live]]
        good = np.flatnonzero((at < end) & (upper < most))
        good = good[self._low(at[good]) == part[good]]
        out[good] = at[good]
        return out

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(U) << U(self.bits)) | self._low(np.arange(self.n))
