"""Similarity join of documents by the Jaccard coefficient of their 5-word shingles, through a MinHash LSH forest.

Every text has TREES signatures of DEPTH least hashes each, kept as byte strings whose prefixes are the nodes of that tree's
trie. Two texts are candidates where they share the *leaf* of some tree. Signatures are sorted, and leaves are found where neighbours
have prefixes in common (`forest`):

* a node of DEPTH hashes is a leaf in any case. At that length a pair at the threshold shares a leaf in one tree or more with
  probability RECALL at least (`depth_for`), so no text ever needs a longer one, however crowded its nodes are;
* matched prefixes are shortened, down to LEAST_DEPTH hashes, where the shorter one's node has few texts: as few as it takes for the
  recall that is expected of the texts on average to reach TARGET. All texts below such a node share it.

1. Texts of one word sequence are one *content*, named by a number of its own; only contents go on.
2. Signatures are sorted once for all trees; one walk gives the sizes of all nodes.
3. Contents are grouped by leaf. A leaf of over BLOCK contents or BLOCK_BYTES of text is dealt into blocks and pairs of blocks,
   so no task holds a whole large leaf. A pair is looked at once, in the first tree where its leaves agree.
4. A pair whose signatures agree in under `sure` of their places is dropped (by default fewer than 1 in 10^5 pairs at the
   threshold); `sure` = 0 drops none.
5. The texts of contents that still have a partner are joined in and the coefficient is computed from the shingles themselves.
   A block returns each content's number of links and a spanning forest of the links, never the pairs.
6. Classes are the connected components of the forests.

Shingles are of words as they stand (runs of characters but space and U+0009 to U+000D); texts of 1 to 4 words are one shingle.
Defined results: null texts and texts without words are classes of their own, without links. Rows with one text, repeated rows
among them, are members of one content; rows that have one id and different texts are different contents, each with its own
links. A null doc_id can't be a class; such rows return a null class and no links, and count for no other row. Every other row
returns its doc_id once for each time it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest
from .components import components
from .forest import TREES
from .store import done_with, materialize, parallelism
from .words import SMALL_CHUNK, Words, chunks, give_back, mix, ranges, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
RECALL, TARGET, SURE = 0.995, 0.9999, 0.58
LEAST_DEPTH = 2
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Pairs that a task looks at together, and bytes of text.
PAIRS, TOGETHER = 1 << 19, 4 << 20


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix at which a pair of that similarity agrees in one tree or more with the wanted probability."""
    depth = 1
    while 1 - (1 - threshold ** (depth + 1)) ** trees >= recall:
        depth += 1
    return depth


DEPTH = depth_for()


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and where each text's begin (with the end of all behind)."""
    h = words.hashes()
    n = np.where(words.counts >= SHINGLE, words.counts - SHINGLE + 1, (words.counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(at[-1], np.uint64)
    long = words.counts >= SHINGLE
    w = window_hashes(h, SHINGLE)
    out[ranges(at[:-1][long], n[long])] = w[ranges(words.starts[long], n[long])]
    for i in np.flatnonzero((words.counts > 0) & ~long):
        out[at[i]] = window_hashes(h[words.starts[i] : words.ends[i]], int(words.counts[i]), 3)[0]
    return out, at


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text's hash and size, 128-bit hash of the word sequence, the trees' signatures, and a byte of each least hash."""
    odd = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in chunks(batches, limit=SMALL_CHUNK):
        words = Words(batch.column("text"))
        batch = batch.filter(pa.array(words.counts > 0))
        words.counts = words.counts[words.counts > 0] if len(words.counts) else words.counts
        words.offsets = np.concatenate([[0], np.cumsum(words.counts)]).astype(np.int64)
        words.starts, words.ends = words.offsets[:-1], words.offsets[1:]
        if not batch.num_rows:
            continue
        with np.errstate(over="ignore"):
            place = (np.arange(len(words.codes)) - np.repeat(words.starts, words.counts)).astype(np.uint64)
            h = words.hashes()
            one = np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), words.starts)
            two = np.add.reduceat(mix(h ^ mix(place + np.uint64(77))), words.starts) + words.counts.astype(np.uint64)
            s, at = shingles(words)
            least = mix(np.stack([np.minimum.reduceat(s * a, at[:-1]) for a in odd], axis=1))
        trees, signs = (least >> np.uint64(32)).astype("<u4"), (least & np.uint64(255)).astype(np.uint8)
        size = pc.binary_length(batch.column("text")).cast(pa.int64())
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), size, pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([x.tobytes() for x in trees], pa.binary()), pa.array([x.tobytes() for x in signs], pa.binary())], names=["doc_id", "text_hash", "size", "c1", "c2", "trees", "signs"])


_GROUP = ["key", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch], text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that come sorted by group, together while they have at most PAIRS pairs and TOGETHER bytes. A group
    has at most two blocks, but for a text that is larger than a block alone."""
    held: list[pa.RecordBatch] = []  # of one group, not known to be over

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.concat_batches(parts)  # an error, and no loss, where 2 GB don't do

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.column_stack([np.asarray(batch.column(c)) for c in _GROUP])
        start = np.r_[0, np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1, len(g)]
        first = 0
        if held and (g[0] == last).all():
            held.append(batch.slice(0, start[1]))
            first = 1
        last = g[-1]
        if first == len(start) - 1:
            continue
        if held:
            yield joined(held)
        held = [batch.slice(start[-2])]
        rows = np.diff(start)
        weight = np.maximum(rows * (rows - 1) / 2 / PAIRS, 0.0)
        if text:
            size = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column(text)), dtype=np.int64))])
            weight += (size[start[1:]] - size[start[:-1]]) / TOGETHER
        whole = first
        while whole < len(start) - 2:
            upto = whole + max(1, int(np.searchsorted(np.cumsum(weight[whole : len(start) - 2]), 1.0, "right")))
            yield batch.slice(start[whole], start[upto] - start[whole])
            whole = upto
    if held:
        yield joined(held)


def _pairs(batch: pa.RecordBatch, sure: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one group and (where the group is of two blocks) of different blocks, whose leaves agree here first and
    whose signatures agree well enough."""
    key, i, j, block = (np.asarray(batch.column(c)) for c in (*_GROUP, "block"))
    n = batch.num_rows
    # the leaf of each tree; 0 is none
    lists = batch.column("leaves")
    flat, length = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
    leaf = np.zeros((n, TREES), np.int64)
    leaf[np.repeat(np.arange(n), length), flat & (TREES - 1)] = flat
    signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.uint8).reshape(n, TREES * DEPTH)
    new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    end = np.r_[np.flatnonzero(new)[1:], n][np.cumsum(new) - 1]
    later = end - np.arange(n) - 1  # partners further down
    total = np.cumsum(later)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        x = np.repeat(np.arange(at, to), later[at:to])
        y = ranges(np.arange(at, to) + 1, later[at:to])
        at = to
        fit = (i[x] == j[x]) | (block[x] != block[y])
        x, y = x[fit], y[fit]
        keep = np.empty(len(x), bool)
        for k in range(0, len(x), 65536):
            p, q = x[k : k + 65536], y[k : k + 65536]
            same = (leaf[p] == leaf[q]) & (leaf[p] != 0)
            keep[k : k + 65536] = (same.argmax(axis=1) == (key[p] & (TREES - 1))) & ((signs[p] == signs[q]).mean(axis=1) >= sure)
        if keep.any():
            yield x[keep], y[keep]


def _wanted(sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a partner in their group."""
        for batch in _groups(batches):
            has = np.zeros(batch.num_rows, bool)
            for x, y in _pairs(batch, sure):
                has[x] = has[y] = True
            yield batch.filter(pa.array(has)).select([*_GROUP, "block", "id"])
        give_back()

    return run


def _common(x: np.ndarray, y: np.ndarray, s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of shingles in common of each pair of rows of one group; rows' shingles are distinct."""
    out = np.zeros(len(x), np.int64)
    rows = np.unique(np.concatenate([x, y]))
    if len(x) < 8 * len(rows):
        for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
            both = np.concatenate([s[at[a] : at[a + 1]], s[at[b] : at[b + 1]]])
            both.sort()
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        return out
    # many pairs of few rows: products of 0/1 matrices, some columns at a time
    n = at[rows + 1] - at[rows]
    _, column = np.unique(s[ranges(at[rows], n)], return_inverse=True)
    row, order = np.repeat(np.arange(len(rows)), n), np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    width = 2048
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(rows), width), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        total += m @ m.T
    return total[np.searchsorted(rows, x), np.searchsorted(rows, y)].astype(np.int64)


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`label` (of each row the least row known to be connected with it) after the edges (x, y)."""
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the groups' rows: for each content the least row it is connected with in its group, and its number of links."""
        for batch in _groups(batches, "text"):
            words = Words(batch.column("text"))
            s, at = shingles(words)
            sets = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]
            size = np.array([len(x) for x in sets], np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            s = np.concatenate(sets)
            links, label = np.zeros(batch.num_rows, np.int64), np.arange(batch.num_rows)
            key, i, j = (np.asarray(batch.column(c)) for c in _GROUP)
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for x, y in _pairs(batch, sure):
                for a, b in zip(*(np.searchsorted(group[x], np.unique(group[x]), side) for side in ("left", "right"))):
                    p, q = x[a:b], y[a:b]
                    both = _common(p, q, s, at)
                    near = both >= THRESHOLD * (size[p] + size[q] - both) - 1e-9
                    p, q = p[near], q[near]
                    links += np.bincount(p, minlength=len(links)) + np.bincount(q, minlength=len(links))
                    label = _joined(label, p, q)
            ids, linked = np.asarray(batch.column("id")), np.flatnonzero(links)
            yield pa.record_batch([pa.array(ids[linked]), pa.array(ids[label[linked]]), pa.array(links[linked])], names=["a", "b", "links"])
        give_back()

    return run


def similar(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """For each row of `docs`: doc_id; class_id, the smallest id of its class; n_links, the number of different word sequences at
    least THRESHOLD similar to the row's own; text_hash, by which rows of one id are told apart; and first, whether it is the row
    of its class that comes first by (doc_id, text_hash). `sure`: see above."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)) | F.col("doc_id").isNull()
    known = rows.where("doc_id is not null")
    signed = materialize(known.mapInArrow(_signatures, "doc_id long, text_hash long, size long, c1 long, c2 long, trees binary, signs binary"), "signatures")
    # a content is known by a number, which a written table keeps, and has the row that comes first
    merged = signed.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "text_hash", "size")).alias("row"), F.first("trees").alias("trees"), F.first("signs").alias("signs"))
    contents = materialize(merged.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "row.*", "trees", "signs"), "contents")
    leaves, tries = forest.leaves(contents, DEPTH, LEAST_DEPTH, THRESHOLD, TARGET, forest.CROWDS)
    owned = leaves.groupBy("id").agg(F.collect_list(F.struct("key", "m", "bytes")).alias("leaf"))  # at most TREES
    owned = owned.join(contents.select("id", "signs"), "id").select("id", "signs", F.col("leaf.key").alias("leaves"), "leaf")
    placed = owned.withColumn("leaf", F.explode("leaf"))
    blocks = F.greatest(F.ceil(F.col("leaf.m") / BLOCK), F.ceil(F.col("leaf.bytes") / BLOCK_BYTES)).cast("int")
    dealt = placed.select("id", "signs", "leaves", F.col("leaf.key").alias("key"), blocks.alias("n")).withColumn("block", F.pmod(F.xxhash64("id", "key"), "n").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "leaves", "signs")
    parts = parallelism(spark)
    wanted = dealt.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_wanted(sure), "key long, i int, j int, block int, id long")
    wanted = materialize(wanted, "wanted")
    # merged at every size: a broadcast of what is wanted would grow with the input
    needed = contents.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "doc_id", "text_hash")
    texts = known.join(needed.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "text")  # of equal rows one
    full = wanted.join(texts, "id").join(owned.select("id", "signs", "leaves"), "id")
    linked = materialize(full.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_verify(sure), "a long, b long, links long"), "links")
    labels = components(linked.select("a", "b"))
    links = linked.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    found = contents.select("id", "c1", "c2", F.struct("doc_id", "text_hash").alias("row")).join(links, "id", "left").join(labels, "id", "left")
    heads = found.where("label is not null").groupBy("label").agg(F.min("row").alias("head"))
    found = found.join(heads, "label", "left").select("c1", "c2", F.coalesce("head", "row").alias("head"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    of = signed.select("doc_id", "text_hash", "c1", "c2").join(found, ["c1", "c2"])
    of = of.select("doc_id", F.col("head.doc_id").alias("class_id"), "n_links", "text_hash", ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("first"))
    # nobody reads the tables on the way behind this
    alone = rows.where(blank).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.lit(True).alias("first"))
    out = materialize(of.unionByName(alone), "classes")
    done_with(signed, contents, tries, wanted, linked)
    return out
