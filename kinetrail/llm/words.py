"""Words of many texts as numpy arrays: spans, 64-bit hashes and hashes of word n-grams."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
ALPHANUMERIC = np.zeros(256, bool)  # after A-Z became a-z: digits, letters and everything beyond ASCII
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = True
ALPHANUMERIC[128:] = True
UNSPACED = np.ones(256, bool)
UNSPACED[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_POWERS: dict[int, np.ndarray] = {}
KEPT = 1 << 21  # longer tables are made anew each time


def powers(n: int, base: int) -> np.ndarray:
    """base**0..n-1 modulo 2**64. Not to be written to: tables of up to KEPT numbers are shared."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = np.ones(max(n, 1), np.uint64)
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
        if n <= KEPT:
            _POWERS[base] = out
    return out[: max(n, 1)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads near values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of many texts: byte spans, hashes and the text that each belongs to. A-Z are lower-cased, and a byte that is in no word is put between texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALPHANUMERIC, hashed: bool = True):
        n = len(offsets) - 1
        self.data = np.full(len(data) + n + 1, 32, np.uint8)
        self.bounds = offsets + np.arange(n + 1)
        inner = np.ones(len(self.data), bool)
        inner[self.bounds[1:] - 1] = False
        inner[-1] = False
        self.data[inner] = _LOWER[data]
        is_word = table[self.data]
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        if len(is_word) and is_word[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.text = np.searchsorted(self.bounds, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(n + 1))
        base = 0x100000001B3
        inverse = pow(base, -1, 1 << 64)
        top = int(max((self.end - self.start).max(initial=0), 1))
        self.hash = np.zeros(len(self.start), np.uint64)
        if len(self.start) and hashed:
            step = 1 << 20  # powers stay small: words are hashed in runs of bytes
            for a in range(0, len(self.start), step // 8):
                s, e = self.start[a : a + step // 8], self.end[a : a + step // 8]
                lo, hi = s[0], e[-1]
                part = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(hi - lo, base), out=part[1:])
                self.hash[a : a + step // 8] = mix((part[e - lo] - part[s - lo]) * powers(hi - lo, inverse)[s - lo] + (e - s).astype(np.uint64) * ODD)
        self.longest = top

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> np.ndarray:
        """Hash of words i..i+k-1 for each i; the greatest number where they are not of one text."""
        n = len(self.hash)
        out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        if n >= k:
            h = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                h = mix(h + self.hash[j : n - k + 1 + j] + ODD)
            same = self.text[: n - k + 1] == self.text[k - 1 :]
            out[: n - k + 1] = np.where(same, h & np.uint64((1 << 63) - 1), out[: n - k + 1])
        return out
