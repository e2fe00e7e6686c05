"""Periodic runs of words, by harmonic grid probing.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least `least` words and
EXPONENT periods, that no neighbouring word extends. Any stretch of 4p words has four grid points (multiples of p, counted
from the document's start), so a run of period p shows as equal words at jp, (j+1)p, (j+2)p and (j+3)p. For all periods
together a document of n words has about n ln n grid points, which are probed as arrays. What survives is extended to both sides by
comparing the words with those p further on, chunk by chunk, the chunks doubling in width.

Periods are taken in blocks [P, 2P): the multiples of a period lie in later blocks. Grid points whose four words lie inside a run found in an
earlier block show that run again (two periods that overlap for their sum are both multiples of the smaller run's period), and
are skipped. So are those inside a stretch that has just been extended. A long run is extended once, not once a multiple.

One pass over the texts, no shuffle: whole documents, cut into chunks between documents only, and the grid of one document in
steps of at most STEP points (or of one period's).

Defined results: null and empty texts have no words and no runs (empty array, empty collapsed text). Repeated rows and rows without
an id are judged each on their own. Columns of the input whose names are those of added ones give way.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import Masked
from .words import SMALL_CHUNK, Words, chunks, ranges

#: A run has so many periods at least. The grid test needs four.
EXPONENT = 4
LEAST_WORDS = 6
#: Grid points probed together.
STEP = 1 << 21
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed_text", T.StringType())]
_FIRST_LOOK = 64


def _extend(codes: np.ndarray, at: int, p: int, lo: int, hi: int) -> tuple[int, int]:
    """The maximal stretch of period p around the equal words `at` and `at` + p, within [lo, hi)."""
    end, width = at + 1, _FIRST_LOOK
    while end + p < hi:
        to = min(end + width, hi - p)
        differ = codes[end:to] != codes[end + p : to + p]
        k = int(differ.argmax())
        if differ[k]:
            end += k
            break
        end, width = to, width * 2
    start, width = at, _FIRST_LOOK
    while start > lo:
        to = max(start - width, lo)
        differ = (codes[to:start] != codes[to + p : start + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            start -= k
            break
        start, width = to, width * 2
    return start, end + p


def _probe(codes: np.ndarray, base: np.ndarray, period: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's grid (`points` multiples of its period from `base` on) those with four equal words: (row, position)."""
    row = np.repeat(np.arange(len(points)), points)
    p = period[row]
    at = base[row] + ranges(np.zeros(len(points), np.int64), points) * p
    left = np.flatnonzero(codes[at] == codes[at + p])
    for k in (1, 2):
        left = left[codes[at[left] + k * p[left]] == codes[at[left] + (k + 1) * p[left]]]
    return row[left], at[left]


class _Found:
    """Runs of earlier blocks of periods, asked whether they cover a stretch."""

    def __init__(self):
        self.start, self.reach = np.empty(0, np.int64), np.empty(0, np.int64)

    def covers(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.start, start, "right")
        return np.r_[-1, self.reach][k] >= end

    def take(self, runs: list[tuple[int, int, int]]) -> None:
        order = sorted((s, e) for s, e, _ in runs)
        self.start = np.array([s for s, _ in order], np.int64)
        self.reach = np.maximum.accumulate(np.array([e for _, e in order], np.int64)) if order else np.empty(0, np.int64)


def find_runs(codes: np.ndarray, starts: np.ndarray, counts: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run, in positions of `codes`. `starts`, `counts`: where the documents lie in it."""
    order = np.argsort(counts, kind="stable")
    n, base = counts[order], starts[order]
    runs: list[tuple[int, int, int]] = []
    found, low, longest = _Found(), 1, int(n[-1]) if len(n) else 0
    while EXPONENT * low <= longest:
        periods = np.arange(low, min(2 * low, longest // EXPONENT + 1))
        first = np.searchsorted(n, np.maximum(EXPONENT * periods, least))
        period = np.repeat(periods, len(n) - first)
        doc = ranges(first, len(n) - first)
        points = np.cumsum((n[doc] - 1) // period - (EXPONENT - 2))
        cut, block = 0, []
        while cut < len(doc):
            to = max(cut + 1, int(np.searchsorted(points, (points[cut - 1] if cut else 0) + STEP, "right")))
            row, at = _probe(codes, base[doc[cut:to]], period[cut:to], np.diff(points[cut:to], prepend=points[cut - 1] if cut else 0))
            row = row + cut
            new = ~found.covers(at, at + (EXPONENT - 1) * period[row] + 1)
            block += _extended(codes, at[new], period[row[new]], base[doc[row[new]]], (base + n)[doc[row[new]]], found, least)
            cut = to
        if block:
            runs += block
            found.take(runs)
        low *= 2
    return runs


def _extended(codes: np.ndarray, at: np.ndarray, period: np.ndarray, lo: np.ndarray, hi: np.ndarray, found: _Found, least: int) -> list[tuple[int, int, int]]:
    order = np.lexsort((at, period))
    points, periods, lows, highs = (x[order].tolist() for x in (at, period, lo, hi))
    out, i = [], 0
    while i < len(points):
        p = periods[i]
        s, e = _extend(codes, points[i], p, lows[i], highs[i])
        if e - s >= max(least, EXPONENT * p) and not found.covers(np.array([s]), np.array([e]))[0]:
            out.append((s, e, p))
        group = bisect_left(periods, p + 1, i)
        i = bisect_left(points, max(e - p, points[i] + 1), i + 1, group)
    return out


def _columns(texts: pa.Array, least: int) -> list[pa.Array]:
    words = Words(texts)
    runs = find_runs(words.codes, words.starts, words.counts, least)
    start, end, period = (np.array([r[k] for r in runs], np.int64) for k in range(3))
    doc = np.searchsorted(words.starts, start, "right") - 1  # the last of the documents that start there: the others are empty
    gone = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone)[:-1] == 0
    before = np.concatenate([[0], np.cumsum(kept)])[words.offsets]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(before, pa.int32()), words.dictionary.take(pa.array(words.codes[kept]))), " ")
    order = np.lexsort((period, start))
    start, end, period, doc = start[order], end[order], period[order], doc[order]
    own = pa.StructArray.from_arrays([pa.array(start - words.starts[doc]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(words.counts) + 1)), pa.int32()), own)
    return [pa.array(words.counts.astype(np.int64)), lists, collapsed.cast(pa.string())]


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, keep_text: bool = True) -> DataFrame:
    """`docs` with n_words, `runs` (start, length, period; by start, then period) and `collapsed_text`: the words joined by one
    space, without those that a run contains after its first period. `keep_text=False` leaves the text column out."""
    m = Masked(docs)
    rows, column = m.as_string(m.df, text)
    drop = set() if keep_text else {m.name(text)}
    kept = [f for f in rows.schema.fields if f.name not in drop | {"_as_text"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column, SMALL_CHUNK):
            arrays = [batch.column(f.name) for f in kept] + _columns(batch.column(column), least)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in [*kept, *ADDED]])

    out = rows.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in kept), *ADDED]))
    return m.restore(out, [f.name for f in ADDED], [f.name for f in kept])


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared as fractions; of equal ones the first."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeat_words(text: Column, key: Column) -> Column:
    """The text with a stretch of its words made periodic, for one key in ten; the rest as it is. A test pattern that depends on the
    key alone: with h = crc32(key), g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8), word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10).cast("long")

    def periodic(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        numbers = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])))[0]
        return F.when(n > 0, F.array_join(F.transform(numbers, lambda i: F.get(ws, i.cast("int"))), " ")).otherwise(F.lit(""))

    # bound as lambda variables, so that nothing is split or hashed once a word
    split = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.when((h % 10 == 0) & text.isNotNull(), F.transform(split, periodic)[0]).otherwise(text)
