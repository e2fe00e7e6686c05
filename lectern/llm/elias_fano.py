"""Elias-Fano sequences as flat byte buffers, read by whole arrays of positions at a time.

A non-decreasing sequence of n integers below u keeps the lowest log2(u / n) bits of each in packed words, and the rest as a bit
vector with one set bit per element and one clear bit per step of the high part: about 2 + log2(u / n) bits an element. Counts
of set bits per 64-bit word make selection a search and a look into one word.
"""

from __future__ import annotations

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: _NTH[b, r]: place of the r-th (from 0) set bit of byte b; 8 if there is none.
_NTH = np.full((256, 8), 8, np.int64)
for _b in range(256):
    _set = np.flatnonzero(_BITS[_b])
    _NTH[_b, : len(_set)] = _set


#: One in each byte, the highest bit of each, and masks of a count of bits by pairs, fours and bytes.
_ONES, _HIGHS, _PAIRS, _FOURS, _EIGHTS = (np.uint64(int(x * (16 // len(x)), 16)) for x in ("01", "80", "5", "3", "0f"))
_U = [np.uint64(k) for k in range(65)]


def encode(values: np.ndarray) -> bytes:
    """`values`: non-decreasing, below 2**62."""
    v = np.asarray(values, np.int64)
    n, u = len(v), int(v[-1]) + 1 if len(v) else 1
    low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
    high = v >> low_bits
    length = n + (int(high[-1]) if n else 0) + 1
    bits = np.zeros(-(-length // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))]).astype("<i8")
    low = np.zeros(-(-n * low_bits // 32) + 2, "<u8")
    if low_bits:
        at = np.arange(n, dtype=np.int64) * low_bits
        part = (v & ((1 << low_bits) - 1)).astype(np.uint64)
        shift = (at & 31).astype(np.uint64)
        # an element spans up to three 32-bit words; each gets its share (low_bits < 62)
        np.bitwise_or.at(low, at >> 5, (part << shift) & np.uint64(0xFFFFFFFF))
        np.bitwise_or.at(low, (at >> 5) + 1, (part >> (np.uint64(32) - shift)) & np.uint64(0xFFFFFFFF))
        if low_bits > 32:
            low = np.concatenate([low, np.zeros(1, "<u8")])
            wide = shift.astype(np.int64) + low_bits > 64
            np.bitwise_or.at(low, (at[wide] >> 5) + 2, part[wide] >> (np.uint64(64) - shift[wide]))
    packed = np.concatenate([low, np.zeros(1, "<u8")]).astype("<u4")
    head = np.array([n, low_bits, length, len(words), len(packed)], "<i8")
    pad = b"\0" * (-len(packed) * 4 % 8)
    return head.tobytes() + words.tobytes() + ones.tobytes() + packed.tobytes() + pad


def _zeros(x: np.ndarray) -> np.ndarray:
    """How many clear bits are below the lowest set one."""
    return np.bitwise_count((x - _U[1]) & ~x).astype(np.int64)


class Sequence:
    """An encoded sequence in a buffer (bytes, or a mapped file's slice)."""

    def __init__(self, buffer: np.ndarray):
        head = buffer[:40].view("<i8")
        self.n, self.low_bits, self.length, words, packed = (int(x) for x in head)
        a, b = 40 + words * 8, 40 + words * 8 + (words + 1) * 8
        self.words = buffer[40:a].view("<u8")
        self.ones = buffer[a:b].view("<i8")
        self.low = buffer[b : b + packed * 4].view("<u4")
        self.clear = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the k-th set bits (clear ones with `flip`): the word by the counts, its byte by sums of all its bytes at once."""
        word = np.searchsorted(counts, k, "right") - 1
        rest = (k - counts[word]).astype(np.uint64)
        x = self.words[np.minimum(word, len(self.words) - 1)]
        x = ~x if flip else x
        sums = x - ((x >> _U[1]) & _PAIRS)
        sums = (sums & _FOURS) + ((sums >> _U[2]) & _FOURS)
        sums = ((sums + (sums >> _U[4])) & _EIGHTS) * _ONES
        passed = (((rest * _ONES) | _HIGHS) - sums) & _HIGHS
        place = np.minimum(((passed >> _U[7]) * _ONES) >> _U[56], _U[7]) << _U[3]
        rest = rest - (((sums << _U[8]) >> place) & np.uint64(255))
        byte = (x >> place) & np.uint64(255)
        return word * 64 + place.astype(np.int64) + _NTH[byte.astype(np.int64), np.minimum(rest, _U[7]).astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        v = (self.low[word].astype(np.uint64) | (self.low[word + 1].astype(np.uint64) << np.uint64(32))) >> shift
        if self.low_bits > 32:
            v |= np.where(shift > 0, self.low[word + 2].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (v & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at positions i (each in 0..n-1)."""
        i = np.asarray(i, np.int64)
        return ((self._select(self.ones, i, False) - i) << self.low_bits) | self._low(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at positions i and i + 1 (i in 0..n-2): the second one's bit is mostly in the word of the first one's."""
        i = np.asarray(i, np.int64)
        place = self._select(self.ones, i, False)
        after = place + 1
        x = self.words[after >> 6] >> (after & 63).astype(np.uint64)
        after += _zeros(x)
        far = np.flatnonzero(x == 0)
        after[far] = self._select(self.ones, i[far] + 1, False)
        return ((place - i) << self.low_bits) | self._low(i), ((after - i - 1) << self.low_bits) | self._low(i + 1)

    def find(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Successor search: the first position in [lo, hi) whose element is `value` or more; hi where there is none."""
        return self.search(value, lo, hi)[0]

    def search(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search, and whether the element there is `value`. Elements of one high part stand together, from behind the clear
        bit of the part before up to the next clear bit, which is mostly in the same word."""
        if not self.n:
            return np.array(hi), np.zeros(len(value), bool)
        high = value >> self.low_bits
        steps = self.length - self.n  # clear bits
        h = np.clip(high, 0, steps - 1)
        place = np.where(h > 0, self._select(self.clear, np.maximum(h - 1, 0), True) + 1, 0)
        x = ~self.words[place >> 6] >> (place & 63).astype(np.uint64)
        start = place - h
        stop = start + _zeros(x)
        far = np.flatnonzero(x == 0)
        stop[far] = self._select(self.clear, h[far], True) - h[far]
        beyond = high >= steps
        a, b = np.clip(np.where(beyond, self.n, start), lo, hi), np.clip(np.where(beyond, self.n, stop), lo, hi)
        b[high < 0] = a[high < 0]
        want = value & ((1 << self.low_bits) - 1)
        last, open_ = b.copy(), np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        same = np.zeros(len(a), bool)
        inside = np.flatnonzero(a < last)
        same[inside] = self._low(a[inside]) == want[inside]
        return a, same
