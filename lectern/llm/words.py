"""Words and word windows of a batch of texts, as flat numpy arrays.

A word is a maximal run of characters other than space and U+0009 to U+000D. All functions work on whole texts; a batch
is cut between documents only, so memory is bounded by the chunk size or by the longest single text.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text that a task looks at together. Operators whose arrays hold several numbers for each word take SMALL_CHUNK.
CHUNK_BYTES, SMALL_CHUNK = 4 << 20, 2 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


#: What empties the cache that an operator keeps in a worker process, by the operator's name.
CACHES: dict[str, Callable[[], None]] = {}


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of `column`, or of one row. Caches of operators other than `owner`, which tasks of
    earlier stages have left in the worker process, are emptied first. Behind the last slice the process, which waits for the
    next stage's tasks, gives back what it has freed."""
    for name, empty in CACHES.items():
        if name != owner:
            empty()
    try:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
            at, n = 0, batch.num_rows
            while at < n:
                base = size[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
                yield batch.slice(at, to - at)
                at = to
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """Words of the texts in one array: `codes` into `vocab` for all texts, `ends` the end of each text's words."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        keep = np.asarray(pc.binary_length(flat)) > 0
        before = np.concatenate([[0], np.cumsum(keep)])
        self.offsets = before[offsets]
        coded = flat.filter(pa.array(keep)).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.dictionary = coded.dictionary
        self.starts, self.ends = self.offsets[:-1], self.offsets[1:]
        self.counts = np.diff(self.offsets)

    @functools.cached_property
    def vocab(self) -> list[str]:
        return self.dictionary.to_numpy(zero_copy_only=False).tolist()

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        return np.repeat(self.ends, self.counts) - np.arange(len(self.codes))

    def vocab_hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each different word, of its bytes as Arrow has them; those of different seeds are independent."""
        own = self.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, own, itertools.repeat(seed)), np.uint64, len(own))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """The same of each word."""
        return self.vocab_hashes(seed)[self.codes]


def first_of_equals(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])


def repeated(key: np.ndarray) -> np.ndarray:
    """Positions, in ascending order, of the values that occur more than once."""
    least = np.sort(key)
    more = np.unique(least[1:][least[1:] == least[:-1]])
    if not len(more):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(more, key), len(more) - 1)
    return np.flatnonzero(more[at] == key)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _M2 ^ (b + _GOLD)) * _M1 ^ (b >> _S33)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each position on; it has len(h) - k + 1 entries (windows that cross texts included)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    bit = 1
    with np.errstate(over="ignore"):
        out, width, power = None, 0, mix(h + np.uint64(seed) * _GOLD) if seed else h
        while bit <= k:
            if k & bit:
                out = power if out is None else _join(out[: len(out) - bit], power[width : width + len(out) - bit]) if len(out) > bit else np.empty(0, np.uint64)
                width += bit
            if bit * 2 <= k:
                power = _join(power[: len(power) - bit], power[bit:])
            bit *= 2
    return mix(out[: len(h) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on."""
    if len(x) < w:
        return x[:0]
    n, width, m = len(x) - w + 1, 1, x
    while width * 2 <= w:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    return np.minimum(m[:n], m[w - width : w - width + n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] numbers, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return shift + np.arange(total)
