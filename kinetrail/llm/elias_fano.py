"""Elias-Fano coding of non-decreasing integers: low bits packed, high bits in unary, with sampled positions for select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = struct.Struct("<qQQQQ")  # least value, count, low bits, bytes of the low part, bytes of the high part


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    planes = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def _unpack(data: np.ndarray, first: int, count: int, bits: int) -> np.ndarray:
    if not bits or not count:
        return np.zeros(count, np.uint64)
    a, b = first * bits, (first + count) * bits
    flat = np.unpackbits(data[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
    return (flat.reshape(count, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def encode(values: np.ndarray) -> bytes:
    """values: non-decreasing 64-bit integers."""
    values = np.asarray(values, np.int64)
    n = len(values)
    least = int(values[0]) if n else 0
    offset = values.astype(np.uint64) - np.uint64(least % (1 << 64))
    top = int(offset[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = _pack(offset & np.uint64((1 << bits) - 1), bits)
    ones = (offset >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    unary[ones] = 1
    high = np.packbits(unary, bitorder="little").tobytes()
    return HEAD.pack(least, n, bits, len(low), len(high)) + low + high + ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Reads what encode() wrote; bytes after it are left alone."""

    def __init__(self, data: bytes):
        self.least, self.n, self.bits, a, b = HEAD.unpack_from(data)
        at = HEAD.size
        self.low = np.frombuffer(data, np.uint8, a, at)
        self.high = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + a + b)
        self.size = at + a + b + 4 * len(self.samples)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one bit on, by counting the ones of bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        return self.least + (((one - i) << self.bits) | int(_unpack(self.low, i, 1, self.bits)[0]))

    def between(self, a: int, b: int) -> np.ndarray:
        """The values a to b - 1, from the part of the high bits that has them."""
        if not a < b:
            return np.zeros(0, np.int64)
        first, last = (((self.select(i) - self.least) >> self.bits) + i for i in (a, b - 1))
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")[first % 8 :])[: b - a].astype(np.uint64) + np.uint64(first)
        offset = ((ones - np.arange(a, b, dtype=np.uint64)) << np.uint64(self.bits)) | _unpack(self.low, a, b - a, self.bits)
        return (offset + np.uint64(self.least % (1 << 64))).astype(np.int64)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        offset = ((ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.bits)) | _unpack(self.low, 0, self.n, self.bits)
        return (offset + np.uint64(self.least % (1 << 64))).astype(np.int64)
