"""The leaves of a MinHash LSH forest, from sorted signatures.

Every content has a signature of `depth` hashes in each of TREES trees. All signatures are sorted once, by tree and then by their bytes,
dealt into even ranges; so a tree's trie lies there in its order, and the node of a prefix is a run of neighbours that have it in
common. A task walks its range once and tells of each signature the runs that it lies in, prefix by prefix: their names, numbers of
contents and bytes of text. A run that touches an end of its range goes on in the next; how large these are is added up over the ranges,
at most two a range and prefix.

What a pair shares is found at the leaf: the shortest prefix whose node has at most `crowd` contents, or the longest. The longer the
prefix, the smaller the chance that a pair at the threshold shares it. `crowd` is the least of CROWDS with which prefixes are short enough
for the target recall, by formula and on average over the contents; so they are shortened as far as the data ask for, and no further.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import done_with, materialize, parallelism
from .words import mix

TREES = 16
#: Bounds of a leaf that are tried, in order.
CROWDS = (8, 16, 32, 64, 128)
NODES = "id long, part int, keys array<long>, m array<long>, bytes array<long>, left array<boolean>, right array<boolean>"


def miss(threshold: float, depth: int) -> float:
    """Log probability that a pair of that similarity doesn't share a prefix of that depth in one tree."""
    return math.log(1 - threshold**depth)


def _walk(least: int, depth: int):
    """Of a sorted range: NODES of every signature that shares its shortest prefix with another, or may do so beyond the range."""
    levels = range(least, depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("id")), np.asarray(b.column("tree")), np.asarray(b.column("size")), np.frombuffer(b"".join(b.column("path").to_pylist()), "<u4").reshape(-1, depth)) for b in batches if b.num_rows]
        if not parts:
            return
        ids, tree, size, path = (np.concatenate(x) for x in zip(*parts))
        del parts
        n, part = len(ids), TaskContext.get().partitionId()
        same = tree[1:] == tree[:-1]
        name = mix(tree.astype(np.uint64) + np.uint64(1))
        keys, m, text, left, right = (np.empty((n, len(levels)), kind) for kind in (np.int64, np.int64, np.int64, bool, bool))
        with np.errstate(over="ignore"):
            for k in range(depth):
                name = mix(name * np.uint64(0x9E3779B97F4A7C15) + path[:, k].astype(np.uint64))
                same = same & (path[1:, k] == path[:-1, k])
                at = k + 1 - least
                if at < 0:
                    continue
                start = np.flatnonzero(np.r_[True, ~same])
                length = np.diff(np.r_[start, n])
                keys[:, at] = (name & ~np.uint64(TREES - 1) | tree.astype(np.uint64)).view(np.int64)
                m[:, at], text[:, at] = np.repeat(length, length), np.repeat(np.add.reduceat(size, start), length)
                left[:, at], right[:, at] = np.arange(n) < length[0], np.arange(n) >= n - length[-1]
        some = np.flatnonzero((m[:, 0] > 1) | left[:, 0] | right[:, 0])
        for a in range(0, len(some), 1 << 14):
            own = some[a : a + (1 << 14)]
            bounds = pa.array(np.arange(len(own) + 1) * len(levels), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[own].reshape(-1))) for x in (keys, m, text, left, right)]
            yield pa.record_batch([pa.array(ids[own]), pa.array(np.full(len(own), part, np.int32)), *lists], names=[c.split()[0] for c in NODES.split(", ")])

    return run


def _summed(nodes: DataFrame) -> DataFrame:
    """`nodes` with the true sizes of the runs that go on beyond their range."""
    depth = F.size("keys")
    numbers = F.sequence(F.lit(0), depth - 1)
    cut = lambda i: F.get("left", i) | F.get("right", i)
    ends = nodes.where(F.exists("left", lambda x: x) | F.exists("right", lambda x: x))
    ends = ends.select("part", F.explode(F.filter(F.transform(numbers, lambda i: F.when(cut(i), F.struct(F.get("keys", i).alias("key"), F.get("m", i).alias("m"), F.get("bytes", i).alias("bytes")))), lambda x: x.isNotNull())).alias("x"))
    per_range = ends.groupBy("part", "x.key").agg(F.first("x.m").alias("m"), F.first("x.bytes").alias("bytes"))
    whole = {r.key: (r.m, r.bytes) for r in per_range.groupBy("key").agg(F.sum("m").alias("m"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where("n > 1").collect()}  # at most two a range and prefix
    if not whole:
        return nodes.select("id", "keys", "m", "bytes")
    held = nodes.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.fromiter(held.value, np.int64, len(held.value)))
        totals = np.array([held.value[k] for k in known.tolist()], np.int64)
        for b in batches:
            keys = np.asarray(b.column("keys").flatten())
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            bounds = b.column("keys").offsets
            new = [np.where(hit, totals[at, k], np.asarray(b.column(c).flatten())) for k, c in enumerate(("m", "bytes"))]
            base = bounds.to_numpy() - bounds[0].as_py()
            yield pa.record_batch([b.column("id"), *(pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(x)) for x in (keys, *new))], names=["id", "keys", "m", "bytes"])

    return nodes.mapInArrow(run, "id long, keys array<long>, m array<long>, bytes array<long>")


def leaves(contents: DataFrame, depth: int, least: int, threshold: float, target: float, crowds: tuple[int, ...] = CROWDS) -> tuple[DataFrame, DataFrame]:
    """(id, key, m, bytes) for every tree in which a content (id, size, trees) shares its leaf: the leaf's name, whose last four bits are the
    tree, its number of contents and their bytes of text. Behind it the written table that it reads."""
    least = min(least, depth)
    path = F.substring("trees", F.col("tree") * (4 * depth) + 1, F.lit(4 * depth))
    rows = contents.select("id", "size", "trees", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("id", "size", "tree", path.alias("path"))
    order = ["tree", "path", "id"]
    nodes = materialize(rows.repartitionByRange(parallelism(contents.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_walk(least, depth), NODES), "nodes")
    sized = materialize(_summed(nodes).where(F.get("m", F.lit(0)) > 1), "tries")
    done_with(nodes)
    leaf = lambda crowd: F.coalesce(F.nullif(F.array_position(F.transform("m", lambda m: m <= crowd), F.lit(True)), F.lit(0).cast("long")), F.size("m").cast("long"))
    crowd = crowds[-1]
    if len(crowds) > 1:
        cost = F.array(*(F.lit(miss(threshold, d)) for d in range(least, depth + 1)))
        # a tree without a partner at the shortest prefix stands at that
        missed = sized.groupBy("id").agg(F.count("*").alias("n"), *(F.sum(F.element_at(cost, leaf(c).cast("int"))).alias(f"c{c}") for c in crowds))
        recall = missed.agg(*(F.avg(1 - F.exp(F.col(f"c{c}") + (TREES - F.col("n")) * miss(threshold, least))).alias(f"c{c}") for c in crowds)).first()
        crowd = next((c for c in crowds if (recall[f"c{c}"] or 1.0) >= target), crowds[-1])
    at = (leaf(crowd) - 1).cast("int")
    return sized.select("id", F.get("keys", at).alias("key"), F.get("m", at).alias("m"), F.get("bytes", at).alias("bytes")).where("m > 1"), sized
