"""Language identification by mixture inference.

Training counts letter trigrams by language over all training rows, hashed into a fixed number of buckets, so the model's
size depends on the number of languages alone. For a document, runs of SEGMENT words are observations whose likelihood under
each language is the product of their trigrams'. Expectation-maximisation estimates the document's language proportions; its
language set (the likeliest one, two, ... languages) grows as long as its penalised likelihood does.

Defined results: `und` with score 0 for null texts, texts without a letter, and for every text if nothing could be learned.
Ties go to the language that sorts first. Repeated rows get equal results; a null doc_id counts as training and not held out.
Rows with a null lang or text teach nothing. Every value of the column is learned, unless `fit` is given a bound: then those
with most trigrams are (of equal ones those that sort first). The model has 128 kB a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import add_text_columns
from .store import materialize
from .words import Words, chunks, ranges

BUCKETS, SEGMENT, ROUNDS, PENALTY = 1 << 15, 16, 12, 3.0
#: Numbers (trigrams, or documents' segments, times languages) that a task computes at a time; a longer text's segments alone.
AT_ONCE = 1 << 22
#: Words times languages up to which a chunk's words are scored once each; beyond, segments are scored by their trigrams.
TABLE = 1 << 24
#: A document of so many segments goes through the rounds alone.
LONG = 256
UNKNOWN = "und"


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves 1 by `folds`."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 1, F.lit(False))


def _trigrams(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram of the words (a blank on either side), and its word's number."""
    if not vocab:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer((" " + " ".join(w.lower() for w in vocab) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blank = points == 32
    key = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    inner = ~blank[1:-1]
    return bucket[inner], (np.cumsum(blank)[1:-1] - 1)[inner]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        bucket, word = _trigrams(words.vocab)
        coded = batch.column("lang").dictionary_encode()
        lang_of_word = np.repeat(np.asarray(coded.indices), words.counts)
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            times = np.bincount(words.codes[lang_of_word == i], minlength=len(words.vocab))
            total[lang] = total.get(lang, 0) + np.bincount(bucket, weights=times[word], minlength=BUCKETS).astype(np.int64)
    for lang, n in total.items():
        seen = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen])], names=["lang", "bucket", "n"])


class Model:
    """`langs` and, for each, the log probability of every bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32) if langs else None

    def sums(self, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of runs of trigrams, which begin `at` the given places; computed AT_ONCE numbers at a time, or one run."""
        out = np.empty((len(at), len(self.langs)), np.float32)
        ends, most = np.r_[at[1:], len(bucket)], max(1, AT_ONCE // len(self.langs))
        k = 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(ends, at[k] + most, "right")))
            np.add.reduceat(self.log_p[bucket[at[k] : ends[to - 1]]], at[k:to] - at[k], axis=0, out=out[k:to])
            k = to
        return out


def fit(rows: DataFrame, most_languages: int | None = None) -> Model:
    """Learn from the `text` and `lang` of all rows in which both are given. `most_languages` bounds the model where the column may be
    dirty; None learns every value."""
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "trigrams")
    if most_languages is not None:
        most = counted.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(most_languages)
        counted = counted.join(F.broadcast(most.select("lang")), "lang")
    packed = counted.groupBy("lang").applyInArrow(_pack, "lang string, counts binary")
    got = sorted(tuple(r) for r in packed.collect())  # a row per language
    counts = np.stack([np.frombuffer(c, "<i8") for _, c in got]) if got else np.zeros((0, BUCKETS))
    return Model([x for x, _ in got], counts)


def _pack(table: pa.Table) -> pa.Table:
    """The counts of one language, BUCKETS at most, in one value."""
    n = np.zeros(BUCKETS, "<i8")
    n[np.asarray(table.column("bucket"))] = np.asarray(table.column("n"))
    return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([n.tobytes()], pa.binary())})


def _em(p: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document; its segments are rows n of `p` from `at` on."""
    w = np.full((len(n), p.shape[1]), 1 / p.shape[1])
    for _ in range(ROUNDS):
        r = np.repeat(w, n, axis=0) * p
        r /= r.sum(axis=1, keepdims=True) + 1e-300
        w = np.add.reduceat(r, at, axis=0) / n[:, None]
    return w, np.add.reduceat(np.log((np.repeat(w, n, axis=0) * p).sum(axis=1) + 1e-300), at)


def _em_long(p: np.ndarray) -> tuple[np.ndarray, float]:
    """The same for one document, whose segments are all rows."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(ROUNDS):
        w = w * (p.T @ (1 / (p @ w + 1e-300))) / len(p)
    return w, float(np.log(p @ w + 1e-300).sum())


class _Scores:
    """What the words of a chunk of texts say for each language."""

    def __init__(self, words: Words, model: Model):
        self.words, self.model = words, model
        self.bucket, word = _trigrams(words.vocab)
        self.start = np.searchsorted(word, np.arange(len(words.vocab)))
        self.count = np.diff(np.r_[self.start, len(self.bucket)])
        self.table = model.sums(self.bucket, self.start) if len(words.vocab) * len(model.langs) <= TABLE else None

    def segments(self, first: np.ndarray, end: int) -> np.ndarray:
        """Log likelihood of each segment (words from `first` on, the last up to `end`) under each language."""
        codes, n_langs = self.words.codes, len(self.model.langs)
        out = np.empty((len(first), n_langs))
        step = max(1, AT_ONCE // (SEGMENT * n_langs))
        for k in range(0, len(first), step):
            own = first[k : k + step]
            inside = codes[own[0] : first[k + step] if k + step < len(first) else end]
            if self.table is not None:
                out[k : k + step] = np.add.reduceat(self.table[inside], own - own[0], axis=0)
            else:
                before = np.concatenate([[0], np.cumsum(self.count[inside])])
                out[k : k + step] = self.model.sums(self.bucket[ranges(self.start[inside], self.count[inside])], before[own - own[0]])
        return out


def mixtures(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text its proportions (documents x languages) and how many languages its set has; zeros without words."""
    words = Words(texts)
    shares, size = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    has = np.flatnonzero(words.counts)
    if not len(has) or not model.langs:
        return shares, size
    segments = -(-words.counts[has] // SEGMENT)
    cut = np.cumsum(segments) * len(model.langs)
    scores, lo = _Scores(words, model), 0
    while lo < len(has):
        hi = max(lo + 1, int(np.searchsorted(cut, (cut[lo - 1] if lo else 0) + AT_ONCE, "right")))
        alone = lo + np.flatnonzero(segments[lo:hi] >= LONG)[:1]
        hi = lo + 1 if len(alone) and alone[0] == lo else int(alone[0]) if len(alone) else hi
        shares[has[lo:hi]], size[has[lo:hi]] = _sets(scores, has[lo:hi], segments[lo:hi])
        lo = hi
    return shares, size


def _sets(scores: _Scores, docs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and set sizes of neighbouring documents, which have n segments each. Sets grow along each document's languages by their
    shares among all; only those columns that a set has are looked at."""
    words = scores.words
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    first = np.repeat(words.starts[docs], n) + (np.arange(n.sum()) - np.repeat(at, n)) * SEGMENT
    p = scores.segments(first, int(words.ends[docs[-1]]))
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    if len(docs) == 1 and n[0] >= LONG:
        return _set_of_long(p)
    order = np.argsort(-_em(p, at, n)[0], axis=1, kind="stable")
    best, size = np.zeros((len(docs), p.shape[1])), np.ones(len(docs), np.int64)
    best_score = np.full(len(docs), -np.inf)
    open_ = np.arange(len(docs))  # whose set has grown so far
    for k in range(1, p.shape[1] + 1):
        own, m = ranges(at[open_], n[open_]), n[open_]
        columns = order[open_, :k]
        w, fit_ = _em(p[own[:, None], np.repeat(columns, m, axis=0)], np.concatenate([[0], np.cumsum(m)[:-1]]), m)
        score = fit_ - PENALTY * (k - 1) * np.log1p(m)
        better = score > best_score[open_]
        open_, columns = open_[better], columns[better]
        if not len(open_):
            break
        best[open_] = 0
        best[open_[:, None], columns] = w[better]
        best_score[open_], size[open_] = score[better], k
    return best, size


def _set_of_long(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one document, in matrix products over the columns in order."""
    order = np.argsort(-_em_long(p)[0], kind="stable")
    p = np.asfortranarray(p[:, order])
    best, size, best_score = np.zeros((1, len(order))), 0, -np.inf
    for k in range(1, len(order) + 1):
        w, fit_ = _em_long(p[:, :k])
        score = fit_ - PENALTY * (k - 1) * np.log1p(len(p))
        if score <= best_score:
            break
        best[:] = 0
        best[0, order[:k]], best_score, size = w, score, k
    return best, np.array([size])


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the main language of each text, its share of the text (0 to 1) and the languages found."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            shares, size = mixtures(texts, model)
            if not model.langs:
                return [pa.array([UNKNOWN] * len(size)), pa.array(np.zeros(len(size))), pa.array(size)]
            return [pa.array([model.langs[i] if s else UNKNOWN for i, s in zip(shares.argmax(axis=1), size)], pa.string()), pa.array(np.clip(shares.max(axis=1), 0, 1)), pa.array(size)]

        return run

    fields = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField("n_languages", T.LongType())]
    found = add_text_columns(docs, fields, make)
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return found.withColumns({pred: F.when(letter, F.col(pred)).otherwise(UNKNOWN), score: F.when(letter & (F.col(pred) != UNKNOWN), F.col(score)).otherwise(F.lit(0.0))})
