"""Bounded-space online packing of tokenised documents into sequences of at most 4096 tokens.

Each input partition keeps a fixed number of open windows. A document's whole blocks become full sequences; its rest goes
to the open window that it fills best. If it fits nowhere, the fullest window is completed with the head of the rest (or
left with a gap of under `MIN_CUT` tokens), emitted, and the remainder tries again. What is still open at the end of the
partitions is merged best-fit, a bounded number of windows at a time.

Nulls and empty texts are documents of the end token alone. Repeated rows are packed once each; a null doc_id stays null.
Columns other than doc_id and text are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .words import CACHES, Words, chunks, ranges

SIZE, END, OPEN_WINDOWS, MIN_CUT = 4096, 2, 8, 16
#: Partitions whose leftovers are merged together: at most so many times OPEN_WINDOWS windows.
MERGE_PARTITIONS = 64
#: Word pieces kept by a worker process; above it the cache starts anew.
CACHE_WORDS = 600_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters whose lower case is one letter whatever stands around it, then punctuation that is always a token run of its own.
_PLAIN = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
_JOINED = 500


class WordIds:
    """Token ids of words. The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those
    of its words in turn, and a plain word's are those of its letters and of its punctuation."""

    def __init__(self, path: str):
        self.encode, self.known = _tokenizer(path), {}

    def _learn(self, plain: list[str], others: list[str]) -> None:
        rows = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        for row, e in zip(rows, self.encode.encode_batch([" ".join(r) for r in rows], add_special_tokens=False)):
            n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(row))
            ids, at = np.array(e.ids, "<u4").tobytes(), np.concatenate([[0], np.cumsum(n * 4)]).tolist()
            for w, a, b in zip(row, at, at[1:]):
                self.known[w] = ids[a:b]
        for w, e in zip(others, self.encode.encode_batch_fast(others, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        if new := [w for w in vocab if w not in known]:
            parts, plain, others = [], {}, {}
            for w in new:
                if m := _PLAIN.fullmatch(w):
                    letters, marks = m[1].lower(), m[2]
                    if letters not in known:
                        plain[letters] = None
                    if marks and marks not in known:
                        others[marks] = None
                    parts.append((w, letters, marks))
                else:
                    others[w] = None
            self._learn(list(plain), list(others))
            known[""] = b""
            for w, letters, marks in parts:
                known[w] = known[letters] + known[marks]
        found = [known[w] for w in vocab]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


@functools.cache
def shared_word_ids(path: str) -> WordIds:
    """One per worker process, so that its words serve all tasks that run there."""
    return WordIds(path)


CACHES["packing"] = shared_word_ids.cache_clear


def doc_ids(texts: pa.Array, word_ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, each with END behind it, and the texts' bounds in it."""
    words = Words(texts)
    ids, n = word_ids(words.vocab)
    at = np.concatenate([[0], np.cumsum(n)])
    per_word = n[words.codes]
    flat = ids[ranges(at[words.codes], per_word)]
    bounds = np.concatenate([[0], np.cumsum(per_word)])[words.offsets] + np.arange(len(words.offsets))
    out = np.full(bounds[-1], END, "<u4")
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = flat
    return out, bounds


class Packer:
    """Windows that are still open, and the rows of pieces that wait to be handed on."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most, self.fill, self.rows, self.n, self.out = size, open_windows, {}, {}, 0, []

    def _emit(self, window: int, closed: bool) -> None:
        self.out += [(*row, window, closed) for row in self.rows.pop(window)]
        del self.fill[window]

    def _put(self, window: int, doc: int, start: int, length: int) -> None:
        self.rows[window].append((doc, start, length, self.fill[window]))
        self.fill[window] += length
        if self.fill[window] == self.size:
            self._emit(window, True)

    def _fresh(self) -> int:
        self.n += 1
        self.fill[self.n], self.rows[self.n] = 0, []
        return self.n

    def add(self, doc: int, tokens: int) -> None:
        whole = tokens - tokens % self.size
        for at in range(0, whole, self.size):
            self._put(self._fresh(), doc, at, self.size)
        at, rest = whole, tokens - whole
        while rest:
            fits = max(((f, w) for w, f in self.fill.items() if f + rest <= self.size), default=None)
            if fits is None and len(self.fill) < self.most:
                fits = (0, self._fresh())
            if fits:
                self._put(fits[1], doc, at, rest)
                return
            fill, window = max((f, w) for w, f in self.fill.items())
            if (gap := self.size - fill) >= MIN_CUT:
                self._put(window, doc, at, gap)
                at, rest = at + gap, rest - gap
            else:
                self._emit(window, True)

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _pack_partition(tokenizer_path: str, size: int, open_windows: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "win", "offset")] + [("closed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, word_ids, packer = TaskContext.get().partitionId(), shared_word_ids(tokenizer_path), Packer(size, open_windows)
        crc: dict[tuple[int, int], int] = {}
        known: dict[int, tuple] = {}  # documents with pieces in open windows
        row = 0

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            cols = [[known[d][0] for d, *_ in pieces], [p[1] for p in pieces], [p[2] for p in pieces], [crc.pop((p[0], p[1])) for p in pieces], [known[d][1] for d, *_ in pieces], [part] * len(pieces), [p[4] for p in pieces], [p[3] for p in pieces], [p[5] for p in pieces]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in chunks(batches, owner="packing"):
            ids, bounds = doc_ids(batch.column("text"), word_ids)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                known[row] = (doc_id, b - a)
                before = len(packer.out)
                had = {w: len(r) for w, r in packer.rows.items()}
                packer.add(row, b - a)
                new = packer.out[before:] + [r for w, rows in packer.rows.items() for r in rows[had.get(w, 0) :]]
                for d, start, length, *_ in new:
                    if d == row and (d, start) not in crc:
                        crc[d, start] = zlib.crc32(ids[a + start : a + start + length])
                row += 1
            if packer.out:
                yield table(packer.drain())
            held = {r[0] for rows in packer.rows.values() for r in rows}
            known = {d: x for d, x in known.items() if d in held}
        for window in sorted(packer.fill):
            packer._emit(window, False)
        if packer.out:
            yield table(packer.drain())

    return run


def _merge(size: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["part", "win", "offset"], kind="stable")
        fills = pieces.groupby(["part", "win"], sort=True)["length"].sum().sort_values(ascending=False, kind="stable")
        bins: list[int] = []
        place: dict[tuple, tuple[int, int]] = {}
        for window, fill in fills.items():
            best = max(((f, i) for i, f in enumerate(bins) if f + fill <= size), default=None)
            if best is None:
                bins.append(0)
                best = (0, len(bins) - 1)
            place[window] = best[::-1]
            bins[best[1]] += fill
        to = [place[w] for w in zip(pieces["part"], pieces["win"])]
        base = (1 << 62) + (int(key[0]) << 32)
        pieces["sequence_id"] = [base + i for i, _ in to]
        pieces["offset"] = pieces["offset"] + [shift for _, shift in to]
        return pieces[[c.split()[0] for c in PIECES.split(", ")]]

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece, see PIECES. The pieces of a sequence lie in it without gaps from offset 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, win long, offset long, closed boolean"
    placed = materialize(rows.mapInArrow(_pack_partition(tokenizer_path, size, open_windows), schema), "packed")
    names = [c.split()[0] for c in PIECES.split(", ")]
    closed = placed.where("closed").withColumn("sequence_id", F.shiftleft("part", 32) + F.col("win")).select(names)
    left = placed.where("not closed").withColumn("merge", F.expr(f"part div {MERGE_PARTITIONS}"))
    return closed.unionByName(left.groupBy("merge").applyInPandas(_merge(size), PIECES))
