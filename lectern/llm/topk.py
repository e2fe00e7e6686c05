"""Exact top-k search by inner product over integer vectors, pruned by multi-resolution segment statistics.

Vectors are quantised to floor(SCALE x). Over equal segments of the dimensions, with means m and deviations s of two vectors
(s: root of the summed squares about the mean), the inner product is at most the sum over segments of length * m_q m_x +
s_q s_x (Cauchy-Schwarz about the means). Squared distance is |q|^2 + |x|^2 - 2 <q, x>, so this is a lower bound on distance.
Bounds are taken coarse to fine over 1, 4 and 16 segments; only candidates whose bound reaches the query's k-th best score so far
go to the next resolution, and the last survivors to exact integer products.

Candidates are dealt into slots of about SLOT rows, or fewer (LEAST_SLOT at least) where there are more tasks. Blocks of queries go to every slot and
meet its candidates, which the task holds as packed arrays: memory is bounded by SLOT. A slot returns k rows per query, and the
final ranking takes those.

Defined results: null vectors and vectors with a null, NaN or infinite component take no part, as query or candidate. Only
vectors of equal length meet. Rows that repeat a vec_id are candidates each for itself, but none of its own id; as queries, rows with
one id and different vectors have a list each, told apart by query_hash, and rows equal in both one list. A null vec_id takes no part. Ties go to the smaller vec_id. A query with fewer than k candidates returns all of them. Scores are exact while
they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import parallelism
from .words import mix, ranges

SCALE, K = 256, 5
QUERY_BLOCK, BLOCK, LEAST_SLOT, SLOT = 256, 4096, 1 << 10, 1 << 16
RESOLUTIONS = (1, 4, 16)
#: While more than one in so many pairs of a block are left, they are bounded and scored by matrix products.
DENSE = 64
#: Products of numbers whose sums stay below this are exact as doubles.
_EXACT = 2.0**53


def _pack(slots: int):
    """Blocks of rows of one length and slot: ids and components as bytes. Without slots: blocks of QUERY_BLOCK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = np.asarray(batch.column("vec_id")).astype("<i8"), batch.column("v")
            bounds, flat = np.asarray(vectors.offsets, dtype=np.int64), np.asarray(vectors.values).astype("<i8")
            dim = np.diff(bounds)
            slot = (mix(ids.view(np.uint64)) % np.uint64(slots)).astype(np.int64) if slots else np.arange(len(ids)) // QUERY_BLOCK
            rows = []
            for d, s in np.unique(np.column_stack([dim, slot]), axis=0).tolist():
                at = np.flatnonzero((dim == d) & (slot == s))
                rows.append((s, d, ids[at].tobytes(), flat[ranges(bounds[at], dim[at])].tobytes()))
            if rows:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["slot", "dim", "ids", "vectors"])

    return run


def _statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment: mean times the root of the length, and deviation."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    length = np.maximum(np.diff(cuts), 1)
    total = np.stack([x[:, a:b].sum(axis=1) for a, b in zip(cuts, cuts[1:])], axis=1)
    square = np.stack([(x[:, a:b] ** 2).sum(axis=1) for a, b in zip(cuts, cuts[1:])], axis=1)
    return total / np.sqrt(length), np.sqrt(np.maximum(square - total**2 / length, 0))


class _Best:
    """The best k (score, id) of each row of a query block, as it meets candidate blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.f = q.astype(float)
        self.stats = {s: _statistics(self.f, s) for s in RESOLUTIONS if s <= max(q.shape[1], 1)}
        self.score = np.full((len(ids), k), -np.inf)
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, x: np.ndarray, stats: dict) -> None:
        f = x.astype(float)
        bound_of_error = 1e-9 * (np.abs(self.f).max(initial=0) * np.abs(f).max(initial=0) * max(x.shape[1], 1) + 1)
        floor = self.score[:, -1]
        if not np.isfinite(floor).all():  # a first guess of the k-th best, from exact scores of some candidates
            some = self._products(np.arange(len(self.ids)), x[: 16 * self.k])
            some = np.where(self.ids[:, None] == ids[None, : 16 * self.k], -np.inf, some)
            guess = np.sort(some, axis=1)[:, -self.k] if some.shape[1] >= self.k else np.full(len(self.ids), -np.inf)
            floor = np.maximum(floor, guess)
        mask, rows, cols = None, None, None
        for s, (m, d) in stats.items():
            qm, qd = self.stats[s]
            if mask is None or (rows is None and self._many(mask.sum(), mask)):  # matrix products, while that many pairs are left
                within = qm @ m.T + qd @ d.T + bound_of_error >= floor[:, None]
                mask = within if mask is None else mask & within
                continue
            if rows is None:
                rows, cols = np.nonzero(mask)
            upper = np.concatenate([np.einsum("ij,ij->i", qm[rows[a : a + 65536]], m[cols[a : a + 65536]]) + np.einsum("ij,ij->i", qd[rows[a : a + 65536]], d[cols[a : a + 65536]]) for a in range(0, len(rows), 65536)] or [np.empty(0)])
            keep = upper + bound_of_error >= floor[rows]
            rows, cols = rows[keep], cols[keep]
        if rows is None:
            rows, cols = np.nonzero(mask)
        other = self.ids[rows] != ids[cols]
        rows, cols = rows[other], cols[other]
        if self._many(len(rows), mask) and self._small(x):
            exact = self._products(np.arange(len(self.ids)), x)[rows, cols].astype(np.int64)
        else:
            exact = np.concatenate([self._pairs(rows[a : a + 65536], x[cols[a : a + 65536]]) for a in range(0, len(rows), 65536)] or [np.empty(0, np.int64)])
        cuts = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        for r in np.unique(rows):
            a, b = cuts[r], cuts[r + 1]
            score, own = exact[a:b], ids[cols[a:b]]
            if b - a > self.k:  # the k best, and those that tie with the last
                best = score >= np.partition(score, -self.k)[-self.k]
                score, own = score[best], own[best]
            got = self.found[r] + list(zip((-score).tolist(), own.tolist()))
            got.sort()
            self.found[r] = got[: self.k]
            for place, (neg, _) in enumerate(self.found[r]):
                self.score[r, place] = -neg

    @staticmethod
    def _many(pairs: int, block: np.ndarray) -> bool:
        """So many of a block's pairs that a matrix product is faster than to gather them."""
        return pairs > block.size // DENSE

    def _products(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.f[rows] @ x.astype(float).T if self._small(x) else (self.q[rows] @ x.T).astype(float)

    def _small(self, x: np.ndarray) -> bool:
        return float(np.abs(self.f).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) < _EXACT

    def _pairs(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.q[rows], x)


def _search(k: int):
    """Of rows sorted by slot, candidates before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, held = None, {}, {}
        for batch in batches:
            for at, is_query, dim, ids, x in zip(*(batch.column(c).to_pylist() for c in ("slot", "is_query", "dim", "ids", "vectors"))):
                if at != slot:
                    slot, parts, held = at, {}, {}
                if not is_query:
                    parts.setdefault(dim, []).append((ids, x))
                    continue
                if dim in parts:  # the first query: all candidates are there
                    rows = parts.pop(dim)
                    v = np.frombuffer(b"".join(r[1] for r in rows), "<i8").reshape(-1, dim) if dim else np.zeros((sum(len(r[0]) // 8 for r in rows), 0), np.int64)
                    held[dim] = np.frombuffer(b"".join(r[0] for r in rows), "<i8"), v, {s: _statistics(v.astype(float), s) for s in RESOLUTIONS if s <= max(dim, 1)}
                if dim in held:
                    qids = np.frombuffer(ids, "<i8")
                    best, (cids, v, stats) = _Best(qids, np.frombuffer(x, "<i8").reshape(len(qids), dim), k), held[dim]
                    for a in range(0, len(cids), BLOCK):
                        best.meet(cids[a : a + BLOCK], v[a : a + BLOCK], {s: (m[a : a + BLOCK], d[a : a + BLOCK]) for s, (m, d) in stats.items()})
                    yield _rows(best)

    return run


def _rows(b: _Best) -> pa.RecordBatch:
    own = [xxhash.xxh3_64_intdigest(q.tobytes()) - (1 << 63) for q in b.q]
    rows = [(int(q), h, i, -n) for q, h, found in zip(b.ids, own, b.found) for n, i in found]
    return pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else ([], [], [], []))], names=["query_id", "query_hash", "vec_id", "score"])


def quantise(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<long>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(SCALE * c)).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score, query_hash) for the rows of `vectors` (vec_id, embedding) that `is_query` picks by vec_id."""
    spark = vectors.sparkSession
    rows = quantise(vectors)
    parts = parallelism(spark)
    n = rows.count()
    slots = max(1, -(-n // SLOT), min(2 * parts, -(-n // LEAST_SLOT)))
    schema = "slot long, dim long, ids binary, vectors binary"
    candidates = rows.mapInArrow(_pack(slots), schema).withColumn("is_query", F.lit(False))
    blocks = rows.where(is_query).distinct().mapInArrow(_pack(0), schema).withColumn("is_query", F.lit(True))
    queries = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<long>")))
    dealt = candidates.unionByName(queries).repartition(parts, "slot").sortWithinPartitions("slot", "is_query")
    found = dealt.mapInArrow(_search(k), "query_id long, query_hash long, vec_id long, score long")
    order = W.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")  # k rows a slot
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_hash")
