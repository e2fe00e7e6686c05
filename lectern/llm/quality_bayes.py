"""Document quality by hierarchical empirical Bayes.

A logistic classifier over style measures and tell-tale words and word beginnings (all that pass a test of significance) gives each document's evidence for being bad and for being
toxic. Hosts and paths below them get Beta posteriors by grouped aggregation of that evidence over all documents: a path's
rate is shrunk toward its host's, a host's toward the global rate, the stronger the fewer documents it has and the less rates
differ on its level. A document's posterior is its evidence with its path's log odds in place of the global ones.

Texts are read and scored once; what goes on are the rows with two numbers of evidence, in a written table.

The classifier alone is fitted on a bounded sample: of the labelled rows that come first by a hash of their id MAX_LABELLED at most, and as
many as have MAX_SAMPLE_BYTES of features together (a longer text has more).

Defined results: a null text is an empty one; null host or path is a site of its own; labels without a document, null labels
and repeated labels beyond the first by value teach nothing; of documents that share a labelled id the least text is taken. Without labels of both kinds the evidence is the prior 0.5 %.
Every input row gives one output row, repeated rows included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import Masked, add_columns
from .store import materialize
from .words import SMALL_CHUNK, Words, chunks, window_hashes

#: Bound of the sample of labelled rows that the classifier is fitted on.
MAX_LABELLED = 16_384
#: Bound of the sample's features, which the driver holds: 4 bytes for each different word or beginning of a text.
MAX_SAMPLE_BYTES = 256 << 20
#: The sample comes to the driver in so many parts.
SAMPLE_PARTS = 64
#: So many sites, those with most documents, are broadcast. Of the others none has more than this part of all documents, and they
#: are joined by a shuffle of their documents alone.
BROADCAST_SITES = 50_000
#: Sites of fewer documents say nothing on how rates differ.
LEAST_DOCS = 20
BUCKETS, LEAST_Z = 1 << 20, 6.0
#: Besides a word itself, its first characters are features, so that forms of a stem that the sample lacks count too.
PREFIXES = (4, 6)
STYLE = ("log_words", "symbols", "bars", "capitals", "repeats", "distinct", "word_length", "exclamations", "line_repeats")
KINDS = ("bad", "toxic")
_MARKS = ".,!?;:\"'()[]"
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def _buckets(vocab: list[str]) -> np.ndarray:
    """Of each word, without what is no letter at its edges (all of it if nothing is left), the bucket of the whole and of each
    prefix, and that of the word without punctuation alone at its edges; BUCKETS where it is shorter, or the same as the first."""
    marked = [w.strip(_MARKS).lower() for w in vocab]
    lower = [w.lower() if w.isalpha() else (_EDGES.sub("", w) or w).lower() for w in vocab]
    digest = xxhash.xxh32_intdigest
    out = np.full((len(vocab), 2 + len(PREFIXES)), BUCKETS, np.int64)
    out[:, 0] = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in lower), np.int64, len(lower))
    for k, size in enumerate(PREFIXES, 1):
        out[:, k] = np.fromiter((digest((w[:size] + " ").encode("utf-8", "surrogatepass")) % BUCKETS if len(w) >= size else BUCKETS for w in lower), np.int64, len(lower))
    out[:, -1] = np.fromiter((digest(m.encode("utf-8", "surrogatepass")) % BUCKETS if m != w else BUCKETS for m, w in zip(marked, lower)), np.int64, len(lower))
    return out


def _measures(texts: pa.Array) -> tuple[np.ndarray, Words, np.ndarray]:
    """Style measures of each text, its words, and the buckets of each word of the vocabulary."""
    texts = pc.fill_null(texts, "")
    words = Words(texts)
    vocab, n = words.vocab, np.maximum(words.counts, 1)
    doc = words.doc_of()
    total = lambda per_word: np.bincount(doc, weights=per_word[words.codes], minlength=len(texts))
    lengths = np.fromiter(map(len, vocab), float, len(vocab))
    chars = np.maximum(total(lengths), 1)
    symbols = np.fromiter((sum(map(w.count, "#*$%&|<>")) if not w.isalnum() else 0 for w in vocab), float, len(vocab))
    bars = np.fromiter((w == "|" for w in vocab), float, len(vocab))
    capitals = np.fromiter((len(w) > 1 and w.upper() == w and w.lower() != w for w in vocab), float, len(vocab))
    exclaims = np.fromiter((w.count("!") for w in vocab), float, len(vocab))
    same = np.zeros(len(words.codes))
    same[1:] = words.codes[1:] == words.codes[:-1]
    same[words.starts[words.counts > 0]] = 0
    distinct = np.bincount(np.unique(doc * np.int64(max(len(vocab), 1)) + words.codes) // max(len(vocab), 1), minlength=len(texts))
    lines = pc.split_pattern(texts, "\n")
    line_n = np.asarray(pc.list_value_length(lines), dtype=float)
    line_doc = np.repeat(np.arange(len(texts)), line_n.astype(int))
    line_code = np.asarray(lines.flatten().dictionary_encode().indices, dtype=np.int64)
    line_distinct = np.bincount(np.unique(line_doc * np.int64(len(line_code) + 1) + line_code) // (len(line_code) + 1), minlength=len(texts))
    measures = np.column_stack([np.log1p(words.counts), total(symbols) / chars, total(bars) / n, total(capitals) / n, np.bincount(doc, weights=same, minlength=len(texts)) / n, distinct / n, chars / n, total(exclaims) / n, 1 - line_distinct / line_n])
    return measures, words, _buckets(vocab)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures, distinct buckets and a sketch (least 5-word window hash: near copies mostly share it) of labelled texts."""
    for batch in chunks(batches, limit=SMALL_CHUNK):
        measures, words, bucket = _measures(batch.column("text"))
        sets, sketches = [], []
        h = words.hashes()
        for a, b in zip(words.starts, words.ends):
            own = np.unique(bucket[words.codes[a:b]])
            sets.append(own[own < BUCKETS].astype("<i4").tobytes())
            w = window_hashes(h[a:b], 5)
            sketches.append(int((w.min() if len(w) else np.uint64(b - a)).view(np.int64)))
        yield pa.record_batch([batch.column("doc_id"), batch.column("bad"), batch.column("toxic"), pa.array([x.tobytes() for x in measures.astype("<f4")], pa.binary()), pa.array(sets, pa.binary()), pa.array(sketches, pa.int64())], names=["doc_id", "bad", "toxic", "style", "buckets", "sketch"])


def _logistic(style: np.ndarray, row: np.ndarray, col: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients of the style measures, of n features of which `row` has `col`, and the constant, by Newton's method. A step is
    solved by conjugate gradients over the pairs that there are, so that its memory is theirs, whatever n is."""
    x = np.column_stack([style, np.ones(len(style))])
    d = style.shape[1]
    split = lambda b: (np.r_[b[:d], b[-1]], b[d:-1])

    def dot(b: np.ndarray) -> np.ndarray:
        dense, words = split(b)
        return x @ dense + np.bincount(row, weights=words[col], minlength=len(x))

    def back(r: np.ndarray) -> np.ndarray:
        dense = x.T @ r
        return np.r_[dense[:-1], np.bincount(col, weights=r[row], minlength=n), dense[-1]]

    b, keep = np.zeros(d + n + 1), np.r_[np.full(d + n, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(dot(b), -30, 30)))
        curve = weight * p * (1 - p)
        dense = (x * x).T @ curve
        diagonal = np.r_[dense[:-1], np.bincount(col, weights=curve[row], minlength=n), dense[-1]] + keep
        step, r = np.zeros(len(b)), back(weight * (y - p)) - keep * b
        z = r / diagonal
        to, rz, first = z, r @ z, r @ z
        for _ in range(2 * len(b)):
            if rz <= 1e-18 * first or rz == 0:
                break
            h = back(curve * dot(to)) + keep * to
            a = rz / (to @ h)
            step, r = step + a * to, r - a * h
            z = r / diagonal
            to, rz = z + (r @ z) / rz * to, r @ z
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b


class Classifier:
    """Per kind: centre and scale of the style measures, the telling buckets, and the coefficients."""

    def __init__(self):
        self.parts: dict[str, tuple] = {}
        self.prior = dict.fromkeys(KINDS, 0.005)

    def log_odds(self, texts: pa.Array) -> list[np.ndarray]:
        measures, words, bucket = _measures(texts)
        doc, out = words.doc_of(), []
        for kind in KINDS:
            if kind not in self.parts:
                out.append(np.full(len(texts), np.log(self.prior[kind] / (1 - self.prior[kind]))))
                continue
            centre, scale, telling, b = self.parts[kind]
            x = np.clip((measures - centre) / scale, -8, 8) @ b[: measures.shape[1]] + b[-1]
            n = max(len(telling), 1)
            which = np.full(BUCKETS + 1, -1)
            which[telling] = np.arange(len(telling))
            pairs = []
            for column in which[bucket].T:
                found = column[words.codes]
                pairs.append(doc[found >= 0] * n + found[found >= 0])
            pairs = np.unique(np.concatenate(pairs))
            x += np.bincount(pairs // n, weights=b[measures.shape[1] + pairs % n], minlength=len(texts))
            out.append(x)
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on the documents of at most MAX_LABELLED rows of `labels` (doc_id, quality 0/1, toxic 0/1), with MAX_SAMPLE_BYTES of features."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("bad"), F.max("toxic").cast("int").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # in small parts, which come to the driver without being stored on the way
    labelled = texts.join(F.broadcast(sample), "doc_id").repartition(SAMPLE_PARTS, "doc_id").groupBy("doc_id", "bad", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(labelled.select("doc_id", "bad", "toxic", "text").mapInArrow(_training_rows, "doc_id long, bad int, toxic int, style binary, buckets binary, sketch long"), "training")
    size = F.octet_length("buckets").cast("long")
    if (rows.agg(F.sum(size)).first()[0] or 0) > MAX_SAMPLE_BYTES:
        # a number for each row of the sample, of which there are few
        running = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
        fits = rows.select("doc_id", size.alias("size")).withColumn("running", running).where(F.col("running") <= MAX_SAMPLE_BYTES).select("doc_id")
        rows = rows.join(fits, "doc_id")
    got = rows.drop("doc_id").repartition(SAMPLE_PARTS).toArrow()
    out = Classifier()
    if not got.num_rows:
        return out
    labels_of = {k: np.asarray(got.column(k)).astype(float) for k in KINDS}
    style = np.frombuffer(b"".join(got.column("style").to_pylist()), "<f4").reshape(got.num_rows, len(STYLE)).astype(float)
    per = np.asarray(pc.binary_length(got.column("buckets"))) // 4
    buckets = np.frombuffer(b"".join(got.column("buckets").to_pylist()), "<i4")
    _, group, size = np.unique(np.asarray(got.column("sketch")), return_inverse=True, return_counts=True)
    weight = 1 / size[group]  # a group of copies counts as one text
    del got
    row = np.repeat(np.arange(len(style), dtype=np.int32), per)
    centre, scale = style.mean(axis=0), style.std(axis=0) + 1e-3
    for kind in KINDS:
        y = labels_of[kind]
        pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
        if min(pos, neg) < 5:
            continue
        a = np.bincount(buckets, weights=(weight * y)[row], minlength=BUCKETS) / pos
        c = np.bincount(buckets, weights=(weight * (1 - y))[row], minlength=BUCKETS) / neg
        pooled = (a * pos + c * neg) / (pos + neg)
        z = (a - c) / np.sqrt(pooled * (1 - pooled) * (1 / pos + 1 / neg) + 1e-9)
        telling = np.flatnonzero(z > LEAST_Z)
        which = np.full(BUCKETS, -1, np.int32)
        which[telling] = np.arange(len(telling))
        hit = which[buckets] >= 0
        out.parts[kind] = (centre, scale, telling, _logistic(np.clip((style - centre) / scale, -8, 8), row[hit], which[buckets[hit]], len(telling), y, weight, 0.5))
    return out


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(rate: Column, variance: Column) -> Column:
    """Strength of a Beta prior by moments: the larger, the less the rates differ."""
    return F.least(F.greatest(rate * (1 - rate) / F.greatest(variance, F.lit(1e-6)) - 1, F.lit(10.0)), F.lit(1000.0))


def _sites(scored: DataFrame, host: str, path: str) -> DataFrame:
    """Of each host and path: documents, and shrunk rates of each kind, as log odds against the global rate."""
    paths = scored.groupBy(F.col(host).cast("string").alias("h"), F.col(path).cast("string").alias("p")).agg(F.count("*").alias("n"), *(F.sum(f"_p_{k}").alias(k) for k in KINDS))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), *(F.sum(k).alias(f"h_{k}") for k in KINDS))
    both = paths.join(hosts.withColumnRenamed("h", "hh"), F.col("h").eqNullSafe(F.col("hh"))).drop("hh")
    differ = lambda size, x: F.coalesce(F.var_samp(F.when(F.col(size) >= LEAST_DOCS, x)), F.lit(0.0))
    total = hosts.agg(F.sum("hn").alias("tn"), *(F.sum(f"h_{k}").alias(f"t_{k}") for k in KINDS), *(differ("hn", F.col(f"h_{k}") / F.col("hn")).alias(f"vh_{k}") for k in KINDS))
    within = both.agg(*(differ("n", F.col(k) / F.col("n") - F.col(f"h_{k}") / F.col("hn")).alias(f"vp_{k}") for k in KINDS))
    one = both.join(F.broadcast(total)).join(F.broadcast(within))  # one row each
    out = []
    for k in KINDS:
        rate = F.greatest(F.col(f"t_{k}") / F.col("tn"), F.lit(1e-6))
        by, below = _strength(rate, F.col(f"vh_{k}")), _strength(rate, F.col(f"vp_{k}"))
        by_host = (F.col(f"h_{k}") + by * rate) / (F.col("hn") + by)
        by_path = (F.col(k) + below * by_host) / (F.col("n") + below)
        out.append((_logit(by_path) - _logit(rate)).alias(f"_site_{k}"))
    return one.select("h", "p", "n", *out)


def classify(docs: DataFrame, model: Classifier, host: str, path: str, keep_text: bool = True) -> DataFrame:
    """`docs`, without the text if it isn't to be kept, with p_bad, p_toxic and quality_ok. Sites are pooled over all of `docs`."""
    m = Masked(docs)
    rows, text = m.as_string(m.df, "text")
    fields = [T.StructField(f"_x_{k}", T.DoubleType()) for k in KINDS]
    rows = add_columns(rows, fields, lambda: lambda batch: [pa.array(x) for x in model.log_odds(batch.column(text))], text, SMALL_CHUNK)
    own = [c for c in m.df.columns if keep_text or c != m.name("text")]
    rows = materialize(rows.select(*own, *(f.name for f in fields)), "evidence")
    at_host, at_path = (m.name(c) for c in (host, path))
    sites = materialize(_sites(rows.withColumns({f"_p_{k}": 1 / (1 + F.exp(-F.col(f"_x_{k}"))) for k in KINDS}), at_host, at_path), "sites")
    own_site = F.col(at_host).cast("string").eqNullSafe(F.col("h")) & F.col(at_path).cast("string").eqNullSafe(F.col("p"))
    if sites.count() <= BROADCAST_SITES:
        both = rows.join(F.broadcast(sites), own_site, "left")
    else:
        large = sites.orderBy(F.desc("n"), "h", "p").limit(BROADCAST_SITES)
        least = large.agg(F.min("n")).first()[0]
        large = sites.where(F.col("n") > least)  # a site of `least` documents or fewer is small
        found = rows.join(F.broadcast(large), own_site, "left")
        small = found.where("n is null").select(rows.columns).join(sites.where(F.col("n") <= least).hint("merge"), own_site, "left")
        both = found.where("n is not null").unionByName(small)
    out = both.select(*own, *((1 / (1 + F.exp(-(F.col(f"_x_{k}") + F.coalesce(F.col(f"_site_{k}"), F.lit(0.0)))))).alias(f"p_{k}") for k in KINDS))
    out = out.withColumn("quality_ok", (F.col("p_bad") < 0.5) & (F.col("p_toxic") < 0.5))
    return m.restore(out, ["p_bad", "p_toxic", "quality_ok"], own)
