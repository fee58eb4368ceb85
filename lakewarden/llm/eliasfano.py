"""Elias-Fano coding of monotone sequences in numpy arrays that can be mapped from a file.

A value is cut into low bits, packed one after the other, and a high part, kept in unary: element ``i`` with high part
``h`` sets bit ``h + i``. Directories of set and unset bits before every 64-bit word let a search start at the right
word. All functions take arrays of queries.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """``values`` don't fall and lie below ``universe``."""
    n = values.size
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = np.zeros(((universe >> low) + n) // 64 + 2, np.uint64)
    np.bitwise_or.at(words, high >> 6, _ONE << (high & 63).astype(np.uint64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    packed = np.zeros(n * low // 64 + 2, np.uint64)
    if low:
        part = v & ((_ONE << np.uint64(low)) - _ONE)
        at = np.arange(n, dtype=np.int64) * low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(packed, word, part << shift)
        over = (at & 63) + low > 64
        np.bitwise_or.at(packed, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    return {
        "meta": np.array([n, low], np.int64),
        "high": words,
        "ones": ones.astype(np.int64),
        "zeros": 64 * np.arange(ones.size, dtype=np.int64) - ones,
        "low": packed,
    }


def _place_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``r`` (from 0) in each word, by halving."""
    word, r, place = word.copy(), r.copy(), np.zeros(r.size, np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & ((_ONE << np.uint64(half)) - _ONE)).astype(np.int64)
        up = r >= below
        r[up] -= below[up]
        place[up] += half
        word[up] >>= np.uint64(half)
    return place


class Sequence:
    """A coded sequence; its arrays may be memory maps."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in parts["meta"])
        self.high, self.low = parts["high"], parts["low"]
        self.ones, self.zeros = parts["ones"], parts["zeros"]

    def _select(self, directory: np.ndarray, r: np.ndarray, flip: np.uint64) -> np.ndarray:
        word = np.searchsorted(directory, r, side="right") - 1
        return word * 64 + _place_in_word(self.high[word] ^ flip, r - directory[word])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(i.size, np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & ((_ONE << np.uint64(self.bits)) - _ONE)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values of elements ``i``."""
        high = self._select(self.ones, i, np.uint64(0)) - i
        return (high.astype(np.uint64) << np.uint64(self.bits) | self.lows(i)).astype(np.int64)

    def successor(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the first element that isn't below ``value`` in ``start`` to ``end``; ``end`` if there is none."""
        v = value.astype(np.uint64)
        high = (v >> np.uint64(self.bits)).astype(np.int64)
        # elements with a smaller high part lie before unset bit number high - 1
        first = np.where(high > 0, self._select(self.zeros, np.maximum(high - 1, 0), _ALL) - (high - 1), 0)
        last = self._select(self.zeros, high, _ALL) - high
        a, b = np.clip(first, start, end), np.clip(last, start, end)
        low = v & ((_ONE << np.uint64(self.bits)) - _ONE)
        open_ = np.flatnonzero(a < b)
        while open_.size:
            mid = (a[open_] + b[open_]) >> 1
            less = self.lows(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return a
