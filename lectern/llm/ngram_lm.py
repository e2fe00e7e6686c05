"""Language-model scoring with a trigram trie in Elias-Fano form.

Tokens are the words of a text, A to Z in lower case, then one end token, which also stands before the first word. Training
counts all tokens, pairs and triples of all training texts; nothing is pruned.

The trie has three levels, each dealt into shards that tasks build on their own and write as one file into the shared folder:

* words: sorted 64-bit hashes and counts. A word's id is its rank among all of them (shards hold ranges of the hash).
* pairs: for a range of words v, monotone pointers to each one's successors; the successors' ids, each plus the last value of
  the context before, so that the level is one monotone sequence; one byte per pair for its log probability and one per context
  for its back-off, by code books of 256 quantiles. A pair's number is its place in the whole level.
* triples: the same for a range of pairs (u, v). The successor w is written relative to the context one word shorter: as its rank
  among the successors of v in the level of pairs, which is what the search in that level gives anyway.

Probabilities are smoothed by the number T of a context's distinct successors (Witten-Bell): P(w|v) = (c(v,w) + T P0(w)) /
(c(v) + T), with P0(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and P(w|u,v) likewise from c(u,v,w) and P(w|v). A text's first token
has the end token alone before it and is scored as a pair. A successor is looked up by successor search among its context's
values; one that is not there has T / (c + T) of its probability in the shorter context, and all of it where the context is
unknown. Files are mapped, not loaded.

Defined results: null texts are empty and have the end token alone. A null doc_id counts as training. Repeated rows are trained
on and scored each for itself. Without training texts every probability is 1. More words, or pairs and successors, than the packed
numbers have bits for raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import add_text_columns
from .elias_fano import Sequence, encode
from .files import mapped, new_name, write
from .store import fresh_dir, parallelism
from .words import Words, chunks, first_of_equals

END = 0x6C656374 << 24  # hash of the end token: fixed, outside what words are likely to hash to
#: Pairs or triples of so many tokens are counted together by a task before they are shuffled.
COUNT_TOKENS = 3 << 20
#: A shard of the pairs, or triples, is to have about so many.
SHARD_TOKENS = 2 << 20
#: A task that builds a shard adds up its rows whenever it holds so many rows more than are different.
HELD_PAIRS = 4 << 20
#: Levels that a task keeps mapped.
OPEN_LEVELS = 256
#: Ids are packed in pairs of 31 bits and a sign.
MOST_WORDS = 1 << 31


class Tokens:
    """All tokens of a chunk's texts: `hash` of each of `vocab`, `codes` of the tokens, `bounds` of the texts."""

    def __init__(self, texts: pa.Array):
        words = Words(pc.ascii_lower(pc.fill_null(texts, "")))
        self.hash = np.append(words.vocab_hashes(), np.uint64(END))
        self.bounds = words.offsets + np.arange(len(words.offsets))
        self.codes = np.full(self.bounds[-1], len(self.hash) - 1, np.int64)
        own = np.ones(len(self.codes), bool)
        self.ends = self.bounds[1:] - 1
        own[self.ends] = False
        self.codes[own] = words.codes

    def before(self) -> np.ndarray:
        """The code of each token's context; the end token's before a text's first."""
        out = np.empty_like(self.codes)
        out[1:] = self.codes[:-1]
        out[:1] = len(self.hash) - 1
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        t = Tokens(batch.column("text"))
        n = np.bincount(t.codes, minlength=len(t.hash))
        yield pa.record_batch([pa.array(t.hash.view(np.int64)), pa.array(n)], names=["h", "n"])


def _write_words(folder: str, shards: int):
    """One file per shard, sorted hashes and then their counts. A partition holds whole shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column("h")).view(np.uint64), np.asarray(b.column("n"))) for b in batches]
        if not got:
            return
        h, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(h)
        h, n = h[order], n[order]
        shard = _word_shard(h, shards)
        rows = []
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            path = new_name(folder, f"words-{s:06d}", ".bin")
            write(path, h[a:b].tobytes() + n[a:b].astype("<i8").tobytes())
            rows.append((int(s), path, int(b - a), int(n[a:b].sum())))
        yield pa.record_batch([pa.array(list(c)) for c in zip(*rows)], names=["shard", "path", "n", "tokens"])

    return run


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash: `shards` is a power of two."""
    return (h >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


class Vocabulary:
    """The word level: paths and sizes of its shards in order of the hash (a few hundred bytes a shard)."""

    def __init__(self, shards: int, rows: list[tuple]):
        self.shards = shards
        self.paths, self.sizes = {s: p for s, p, *_ in rows}, {s: n for s, _, n, _ in rows}
        base = np.zeros(shards + 1, np.int64)
        for s, n in self.sizes.items():
            base[s + 1] = n
        self.base = np.cumsum(base)
        self.size, self.tokens = int(self.base[-1]), sum(r[3] for r in rows)

    def _shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        data, n = mapped(self.paths[s]), self.sizes[s]
        return data[: 8 * n].view("<u8"), data[8 * n :].view("<i8")

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        order = np.argsort(h)
        shard = _word_shard(h[order], self.shards)
        for s in np.unique(shard):
            if s in self.paths:
                a, b = np.searchsorted(shard, [s, s + 1])
                keys, n = self._shard(int(s))
                at = np.minimum(np.searchsorted(keys, h[order[a:b]]), len(keys) - 1)
                found = keys[at] == h[order[a:b]]
                ids[order[a:b][found]] = self.base[s] + at[found]
                counts[order[a:b][found]] = n[at[found]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by ids in ascending order."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.base)
        for s in self.paths:
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out[a:b] = self._shard(s)[1][ids[a:b] - self.base[s]]
        return out

    def log_p0(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.size + 1)))


def _blocks(held: list[tuple[np.ndarray, ...]], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Of numbers of a context and its successor, packed as context << bits | successor: one block per shard of `width` contexts,
    with packed arrays of the context within the shard, the successor, the count, and what else goes with them, which is the same for
    equal numbers."""
    keys, *rest = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys) if rest else None
    keys = keys[order] if rest else np.sort(keys)
    first = first_of_equals(keys)
    rest = [x[order[first]] for x in rest]
    keys, n = keys[first], np.diff(np.append(first, len(keys)))
    v, w = keys >> bits, keys & ((1 << bits) - 1)
    # only the shards that these contexts are of
    shard = v // width
    first = first_of_equals(shard)
    own, cuts = shard[first], np.append(first, len(v))
    columns = [x.astype("<u4") for x in (v % width, w, n)] + rest
    names = ["shard", "v", "w", "n", "lower"][: 1 + len(columns)]
    for lo in range(0, len(own), 64):
        rows = [(int(own[k]), *(x[cuts[k] : cuts[k + 1]].tobytes() for x in columns)) for k in range(lo, min(lo + 64, len(own)))]
        yield pa.record_batch([pa.array(list(c), pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows))], names=names)


def _counted(keys, bits: int, width: int):
    """Blocks of what `keys(tokens)` gives for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches):
            t = Tokens(batch.column("text"))
            held.append(keys(t))
            size += len(t.codes)
            if size >= COUNT_TOKENS:
                yield from _blocks(held, bits, width)
                held, size = [], 0
        if held:
            yield from _blocks(held, bits, width)

    return run


def _pair_keys(vocabulary: Vocabulary):
    def keys(t: Tokens) -> tuple[np.ndarray]:
        ids, _ = vocabulary.lookup(t.hash)
        return ((ids[t.before()] << 32) | ids[t.codes],)

    return keys


def _triple_keys(vocabulary: Vocabulary, pairs: Trie, bits: int):
    """The number of the pair before each token but a text's first, the token's rank behind the pair's word, and its log
    probability there in half precision (books have less)."""

    def keys(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        found = Found(t, vocabulary, pairs)
        a, b = found.inner()
        return (found.place[a] << bits) | found.rank[b], found.p[b].astype("<f2")

    return keys


def _book(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code book of 256 quantiles and each value's nearest entry."""
    book = np.unique(np.quantile(values, np.linspace(0, 1, 256), method="nearest").astype("<f4"))
    code = np.searchsorted((book[1:] + book[:-1]) / 2, values)
    return np.concatenate([book, np.full(256 - len(book), book[-1], "<f4")]), code.astype(np.uint8)


def _add_up(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One block of different rows (context, successor, count as 64 bits, and what goes with them), sorted, of many."""
    v, w, n, *rest = (np.concatenate(x) for x in zip(*blocks))
    key = (v.astype(np.int64) << 32) | w
    order = np.argsort(key)
    key = key[order]
    first = first_of_equals(key)
    key = key[first]
    return [(key >> 32).astype("<u4"), (key & 0xFFFFFFFF).astype("<u4"), np.add.reduceat(n[order].astype(np.int64), first), *(x[order[first]] for x in rest)]


def _word_p0(vocabulary: Vocabulary, w: np.ndarray) -> np.ndarray:
    by_word = np.argsort(w, kind="stable")
    out = np.empty(len(w))
    out[by_word] = vocabulary.log_p0(vocabulary.counts(w[by_word]))
    return out


def _build(folder: str, name: str, width: int, contexts: int, vocabulary: Vocabulary | None = None):
    """Files of a level over `contexts` contexts. A partition has all blocks of its shards, sorted by shard; one shard is held at a
    time. Its blocks are added up whenever HELD_PAIRS rows, or as many as its different ones, have come: what is held grows with the
    different rows, not with the blocks. The probabilities of the level below come with the rows, or from the vocabulary."""
    columns = ("v", "w", "n") if vocabulary else ("v", "w", "n", "lower")

    def one(size: int, v: np.ndarray, w: np.ndarray, n: np.ndarray, lower: np.ndarray | None = None) -> tuple[bytes, int]:
        v, w = v.astype(np.int64), w.astype(np.int64)
        degree = np.bincount(v, minlength=size)
        total = np.bincount(v, weights=n, minlength=size)
        pointers = np.concatenate([[0], np.cumsum(degree)])
        p0 = 10 ** (_word_p0(vocabulary, w) if vocabulary else lower.astype(float))
        p = np.log10((n + degree[v] * p0) / (total[v] + degree[v]))
        # each context's values stand above the last value of the context before
        last = np.where(degree > 0, w[np.maximum(pointers[1:] - 1, 0)] + 1, 0)
        shift = np.concatenate([[0], np.cumsum(last)[:-1]])
        p_book, p_code = _book(p)
        seen = degree > 0
        backoff = np.zeros(size)
        backoff[seen] = np.log10(degree[seen] / (total[seen] + degree[seen]))
        b_book, b_code = _book(backoff)
        parts = [encode(pointers), encode(w + shift[v]), p_book.tobytes(), b_book.tobytes(), p_code.tobytes(), b_code.tobytes()]
        parts = [x + b"\0" * (-len(x) % 8) for x in parts]
        return np.cumsum([48] + [len(x) for x in parts[:-1]]).astype("<i8").tobytes() + b"".join(parts), int(degree.max())

    def built(s: int, blocks: list) -> pa.RecordBatch:
        path, rows = new_name(folder, f"{name}-{s:06d}", ".trie"), _add_up(blocks)
        data, most = one(min(width, contexts - s * width), *rows)
        write(path, data)
        return pa.record_batch([pa.array([s], pa.int32()), pa.array([path]), pa.array([len(rows[0])]), pa.array([most])], names=["shard", "path", "n", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows, least = None, [], 0, HELD_PAIRS
        for b in batches:
            for s, *block in zip(*(b.column(c).to_pylist() for c in ("shard", *columns))):
                if s != at and held:
                    yield built(at, held)
                    held, rows, least = [], 0, HELD_PAIRS
                at = s
                held.append([np.frombuffer(x, kind) for x, kind in zip(block, ("<u4", "<u4", "<u4", "<f2"))])
                rows += len(held[-1][0])
                if rows >= least:
                    held = [_add_up(held)]
                    rows = len(held[0][0])
                    least = rows + max(HELD_PAIRS, rows)
        if held:
            yield built(at, held)

    return run


class Level:
    """A shard of a level over a mapped file: a range of contexts and their successors."""

    def __init__(self, path: str):
        data = mapped(path)
        at = data[:48].view("<i8").tolist()
        self.pointers, self.values = Sequence(data[at[0] :]), Sequence(data[at[1] :])
        self.p_book, self.b_book = data[at[2] : at[2] + 1024].view("<f4"), data[at[3] : at[3] + 1024].view("<f4")
        self.p_code, self.b_code = data[at[4] :], data[at[5] :]

    def find(self, v: np.ndarray, w: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of successors w (-1: unknown) of local contexts v, in order of v: log10 P, place in the shard and rank behind v (-1: not
        there). `lower`: log10 P in the shorter context."""
        first = first_of_equals(v)
        own, n = v[first], np.diff(np.append(first, len(v)))
        a, b = self.pointers.get_two(own)
        # the shift of a context: what all contexts before it have reached, that is the last value before it, plus one
        prior, s = (b > a) & (a > 0), np.zeros(len(own), np.int64)
        s[prior] = self.values.get(a[prior] - 1) + 1
        lo, hi, shift = np.repeat(a, n), np.repeat(b, n), np.repeat(s, n)
        used = hi > lo
        at, hit = self.values.search(w + shift, lo, hi)
        hit &= w >= 0
        out = np.array(lower, float)
        out[hit] = self.p_book[self.p_code[at[hit]]]
        miss = used & ~hit
        out[miss] += self.b_book[self.b_code[v[miss]]]
        return out, np.where(hit, at, -1), np.where(hit, at - lo, -1)


class Trie:
    """A level: what a task needs to find its files. `made`: shard, path, rows and most successors of a context of each."""

    def __init__(self, width: int, shards: int, made: list[tuple]):
        self.width, self.shards, self.paths = width, shards, {s: path for s, path, *_ in made}
        count = np.zeros(shards + 1, np.int64)
        for s, _, n, _ in made:
            count[s + 1] = n
        self.base = np.cumsum(count)
        self.size, self.most = int(self.base[-1]), max((r[3] for r in made), default=0)
        self._levels: dict[int, Level] = {}

    def __getstate__(self):
        return self.__dict__ | {"_levels": {}}

    def find(self, v: np.ndarray, w: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Level.find, for contexts of the whole level in ascending order (-1: unknown), with places in the whole level."""
        p, place, rank = np.array(lower, float), np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
        cuts = np.searchsorted(v, np.arange(self.shards + 1) * self.width)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if s in self.paths:
                a, b = cuts[s], cuts[s + 1]
                p[a:b], at, rank[a:b] = self._level(s).find(v[a:b] - s * self.width, w[a:b], lower[a:b])
                place[a:b] = np.where(at >= 0, at + self.base[s], -1)
        return p, place, rank

    def _level(self, s: int) -> Level:
        """The level of a shard; of those in use the last OPEN_LEVELS are kept."""
        level = self._levels.pop(s, None) or Level(self.paths[s])
        self._levels[s] = level
        if len(self._levels) > OPEN_LEVELS:
            del self._levels[next(iter(self._levels))]
        return level


class Found:
    """The different pairs of a chunk, in order of their ids, looked up: `p`, `place` and `rank` of each, `back` the pair of each
    token, and `known` (is its word) and `p0` of each token."""

    def __init__(self, t: Tokens, vocabulary: Vocabulary, pairs: Trie):
        ids, counts = vocabulary.lookup(t.hash)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        ids, p0 = ids[order], vocabulary.log_p0(counts[order])
        word = rank[t.codes]
        key, self.back = np.unique(rank[t.before()] * len(ids) + word, return_inverse=True)
        v, w = key // len(ids), key % len(ids)
        self.p, self.place, self.rank = pairs.find(ids[v], ids[w], p0[w])
        self.known, self.p0, self.first = counts[t.codes] > 0, p0[word], t.bounds[:-1]

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """The pair before, and the own one, of each token that is not a text's first."""
        own = np.ones(len(self.back), bool)
        own[self.first] = False
        at = np.flatnonzero(own)
        return self.back[at - 1], self.back[at]

    def scores(self, triples: Trie) -> np.ndarray:
        """log10 P of each token."""
        out, n = self.p[self.back], len(self.p)
        a, b = self.inner()
        key, back = np.unique(a * n + b, return_inverse=True)
        a, b = key // n, key % n
        p = self.p[b]
        known = self.place[a] >= 0
        p[known] = triples.find(self.place[a[known]], self.rank[b[known]], p[known])[0]
        own = np.ones(len(out), bool)
        own[self.first] = False
        out[own] = p[back]
        return out


class Model:
    """Vocabulary and both levels of successors."""

    def __init__(self, vocabulary: Vocabulary, pairs: Trie, triples: Trie):
        self.vocabulary, self.pairs, self.triples = vocabulary, pairs, triples


def train(docs: DataFrame) -> Model:
    """Learn from the text of every row."""
    spark = docs.sparkSession
    rows, folder, parts = docs.select(F.col("text").cast("string").alias("text")), fresh_dir(spark, "trie"), parallelism(spark)
    shards = 1 << max(0, (parts - 1).bit_length())
    counted = rows.mapInArrow(_count_words, "h long, n long")
    shard = F.shiftrightunsigned("h", 65 - shards.bit_length()).cast("int") if shards > 1 else F.lit(0)
    words = counted.groupBy("h").agg(F.sum("n").alias("n")).repartition(parts, shard)
    made = words.mapInArrow(_write_words(folder, shards), "shard long, path string, n long, tokens long").collect()  # a row per shard
    vocabulary = Vocabulary(shards, [tuple(r) for r in made])
    if vocabulary.size >= MOST_WORDS:
        raise ValueError(f"{vocabulary.size} different words: ids of pairs would not fit 64 bits")
    shards = max(parts, -(-vocabulary.tokens // SHARD_TOKENS))

    def level(name: str, contexts: int, keys, bits: int, own: Vocabulary | None = None) -> Trie:
        width = -(-max(contexts, 1) // shards)
        fields = "shard int, v binary, w binary, n binary" + ("" if own else ", lower binary")
        blocks = rows.mapInArrow(_counted(keys, bits, width), fields).repartition(shards, "shard").sortWithinPartitions("shard")
        made = blocks.mapInArrow(_build(folder, name, width, contexts, own), "shard int, path string, n long, most long").collect()  # a row per shard
        return Trie(width, shards, [tuple(r) for r in made])

    pairs = level("pairs", vocabulary.size, _pair_keys(vocabulary), 32, vocabulary)
    bits = max(1, pairs.most.bit_length())
    if pairs.size.bit_length() + bits > 63:
        raise ValueError(f"{pairs.size} different pairs, up to {pairs.most} of a word: numbers of triples would not fit 64 bits")
    return Model(vocabulary, pairs, level("triples", pairs.size, _triple_keys(vocabulary, pairs, bits), bits))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with n_tokens, n_known, train_tokens, base_score and score."""
    vocabulary = model.vocabulary

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        t = Tokens(texts)
        found = Found(t, vocabulary, model.pairs)
        sums = lambda x: np.add.reduceat(x, t.bounds[:-1]) if len(t.codes) else np.zeros(0)
        n = np.diff(t.bounds)
        return [pa.array(n), pa.array(sums(found.known.astype(np.int64)).astype(np.int64)), pa.array(np.full(len(n), vocabulary.tokens)), pa.array(sums(found.p0)), pa.array(sums(found.scores(model.triples)))]

    kinds = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    return add_text_columns(docs, [T.StructField(k, v) for k, v in kinds.items()], lambda: per_batch)
