"""Elias-Fano encoding of non-decreasing integers, with select."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QQB")
#: Ones between two stored positions of the select structure.
EVERY = 64


def pack(values: np.ndarray) -> bytes:
    """values: non-decreasing, not negative. About 2 + log2(last / n) bits each, and 1/2 bit for select."""
    values = np.asarray(values, np.int64)
    n = len(values)
    last = int(values[-1]) if n else 0
    low_bits = max(0, (last // n).bit_length() - 1) if n else 0
    lows = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
    ones = (values >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    low = np.packbits(lows.ravel(), bitorder="little").tobytes()
    return HEAD.pack(n, last, low_bits) + ones[::EVERY].astype("<u4").tobytes() + low + np.packbits(high, bitorder="little").tobytes()


class EliasFano:
    """Reads what pack() gave; nothing is unpacked beforehand."""

    def __init__(self, data: bytes):
        self.n, self.last, self.low_bits = HEAD.unpack_from(data)
        samples = -(-self.n // EVERY)
        at = HEAD.size
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        size = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(data, np.uint8, size, at)
        self.high = np.frombuffer(data, np.uint8, offset=at + size)

    def select(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY  # the position of a one; `left` ones further is the one wanted
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        high = byte * 8 + (bits & -bits).bit_length() - 1 - i
        first = i * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little") >> (first & 7) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every value: select for all places at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        lows = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.int64)
        return (ones - np.arange(self.n)) << self.low_bits | (lows << np.arange(self.low_bits)).sum(axis=1)
