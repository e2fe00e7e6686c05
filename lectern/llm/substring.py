"""Substring deduplication over a log-structured index of fingerprints.

A word window (WINDOW words) is removed where its word sequence also starts earlier: in a document of smaller id, or before
it in the same document. Every window has a fingerprint, the least hash of the GRAM-word sequences in it. Neighbouring
windows mostly share it, so a document becomes a few *stretches*: windows in a row with one fingerprint, and one hash of all
their words. Equal windows have equal fingerprints, so

* a stretch whose words are those of an earlier stretch goes as a whole (64 bits each of two independent hashes of the words);
* only where one fingerprint has stretches of different words are single windows compared, by 128 bits of two independent
  hashes of the words themselves, read again from the texts: the verification.

The index is a list of runs that are never changed. A run is a table of first stretches, bucketed by fingerprint and sorted
within its buckets. A batch of later documents is hashed, its fingerprints are merge-joined with every run (a run is read in its
order, and never shuffled), and the stretches that are new are written as a run of level 0. As many runs of one level as the
fan-out says are merged into one of the next level, so that a stretch is rewritten once a level. A manifest beside the runs
names those that count; whoever opens the folder later goes on from there.

Windows that repeat within one document are found when its text is read last, so no group of windows is ever collected beyond one
document's own. Stretches and windows that repeat within a task's chunk of documents are settled there; only the first is
shuffled. What fingerprints have in common is found by grouped minima and joins, which Spark splits where a key is hot.

Rows are told apart by doc_id and a hash of the text. Defined results: null and empty texts have no words. A null doc_id is neither
smaller nor greater than another, so such documents lose their own repetitions only and take nothing from others. Rows that share a doc_id don't
stand before each other, whether their texts are the same or not: each loses what stands in documents of smaller id, and its own
repetitions. Ids may have any value of a long. No row is ever dropped.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import Masked, add_columns
from .store import discard, done_with, exists, fresh_dir, materialize, parallelism
from .words import SMALL_CHUNK, Words, chunks, mix, ranges, repeated, sliding_min, window_hashes

WINDOW, GRAM = 20, 5
#: So many runs of one level are merged into one of the next.
FAN_OUT = 2
STRETCH = "fp long, content long, doc_id long, text_hash long, start int, n int, settled boolean"
RUN = ["fp", "content", "doc_id", "text_hash", "start", "n"]
#: A row's identity, and a stretch of its windows.
ROW = ["doc_id", "text_hash"]
SPAN = [*ROW, "start", "n"]
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _stretches(h: np.ndarray, h2: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, fingerprint, content hash) of every stretch."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    fp = sliding_min(window_hashes(h, GRAM), WINDOW - GRAM + 1)
    doc = words.doc_of()
    inside = words.left()[:n] >= WINDOW
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (fp[1:] != fp[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(new)
    # a stretch ends where the next one starts or its document has no further window
    last = np.minimum(np.r_[first[1:], n], words.ends[doc[first]] - WINDOW + 1)
    count = last - first
    # hash of all its words, from its windows' hashes
    whole = window_hashes(h2, WINDOW, 1)
    with np.errstate(over="ignore"):
        weight = mix(np.arange(1, int(count.max()) + 1, dtype=np.uint64) if len(count) else np.empty(0, np.uint64)) | np.uint64(1)
        at = ranges(first, count)
        step = ranges(np.zeros(len(first), np.int64), count)
        content = np.add.reduceat(whole[at] * weight[step], np.cumsum(np.r_[0, count[:-1]])) if len(first) else np.empty(0, np.uint64)
        content = mix(content + count.astype(np.uint64))
    return doc[first], first - words.starts[doc[first]], count, fp[first], content


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id"), dtype=np.int64)


def _hash_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches by STRETCH. Those with the words of one in a smaller document of the chunk, or before it in the row, are settled."""
    for batch in chunks(batches, limit=SMALL_CHUNK):
        batch = batch.take(pa.array(np.argsort(_ids(batch), kind="stable")))
        words = Words(batch.column("text"))
        doc, start, count, fp, content = _stretches(words.hashes(), words.hashes(1), words)
        key = mix(fp.astype(np.uint64) ^ (content.astype(np.uint64) << np.uint64(1)))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        ids = _ids(batch)[doc]
        settled = (ids > ids[first][of]) | ((doc == doc[first][of]) & (start > start[first][of]))
        arrays = [pa.array(fp.astype(np.uint64).view(np.int64)), pa.array(content.astype(np.uint64).view(np.int64)), pa.array(ids), batch.column("text_hash").take(pa.array(doc)), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(settled)]
        yield pa.record_batch(arrays, names=[*RUN, "settled"])


class FingerprintIndex:
    """Runs of first stretches of all documents added so far. Documents must come in ascending order of id, batch by batch.

    `folder`: where the index lies or is to lie (a new one in the shared folder if not given). An index there is gone on with. While it
    is open, runs have names in the session's catalog and bucketed tables are read in their order; `close` undoes both."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_out: int = FAN_OUT):
        self.spark, self.folder, self.fan_out = spark, folder or fresh_dir(spark, "fingerprints"), fan_out
        # one file a bucket, read in its order: no shuffle and no sort of a run
        self.ordered = spark.conf.get(_ORDERED)
        spark.conf.set(_ORDERED, "true")
        self.version, self.buckets, self.runs = 0, parallelism(spark), []
        if folder is not None and exists(spark, self._manifest):
            rows = spark.read.schema("version int, buckets int, level int, path string").json(self._manifest)
            self.version = rows.agg(F.max("version")).first()[0]
            for r in rows.where(F.col("version") == self.version).collect():  # a row for each run
                self.buckets = r.buckets
                self.runs.append((r.level, r.path, self._register(r.path)))

    @property
    def _manifest(self) -> str:
        return f"{self.folder}/manifest"

    def _register(self, path: str) -> str:
        """A name for the run at a path: bucketing is known by the catalog alone. Dropping the name leaves the files."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, content BIGINT, doc_id BIGINT, text_hash BIGINT, start INT, n INT) USING parquet CLUSTERED BY (fp) SORTED BY (fp, content) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _write(self, stretches: DataFrame, level: int) -> tuple[int, str, str]:
        path, name = f"{self.folder}/run-{uuid.uuid4().hex}", f"fingerprints_{uuid.uuid4().hex}"
        own = stretches.select(*RUN).repartition(self.buckets, "fp")
        own.write.bucketBy(self.buckets, "fp").sortBy("fp", "content").format("parquet").option("path", path).saveAsTable(name)
        return level, path, name

    def _commit(self) -> None:
        """A new version of the manifest; the runs that it doesn't name are dropped after it stands."""
        self.version += 1
        rows = [(self.version, self.buckets, level, path) for level, path, _ in self.runs]
        self.spark.createDataFrame(rows, "version int, buckets int, level int, path string").coalesce(1).write.mode("append").json(self._manifest)

    def close(self, keep: bool = True) -> None:
        """Take the runs' names out of the catalog; plans that read them have to be done. `keep=False` deletes the index."""
        for _, _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []
        self.spark.conf.set(_ORDERED, self.ordered)
        if not keep:
            discard(self.spark, self.folder)

    def history(self) -> list[DataFrame]:
        return [self.spark.table(name) for _, _, name in self.runs]

    def compact(self) -> None:
        """Merge the runs of each level that has its fan-out of them. Of equal stretches the first stays."""
        level = 0
        while any(at >= level for at, *_ in self.runs):
            own = [r for r in self.runs if r[0] == level]
            if len(own) >= self.fan_out:
                rows = self.spark.table(own[0][2])
                for _, _, name in own[1:]:
                    rows = rows.unionByName(self.spark.table(name))
                first = rows.groupBy("fp", "content").agg(F.min(F.struct(*SPAN)).alias("s")).select("fp", "content", "s.*")
                self.runs = [r for r in self.runs if r[0] != level] + [self._write(first, level + 1)]
                self._commit()
                for _, path, name in own:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                    discard(self.spark, path)
            level += 1

    def known(self, fps: DataFrame) -> DataFrame | None:
        """The runs' stretches whose fingerprint is in `fps` (fp)."""
        found = [run.join(fps.select("fp").hint("merge"), "fp", "left_semi").select(*RUN) for run in self.history()]
        return functools.reduce(DataFrame.unionByName, found) if found else None

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Take a batch in. Returns its stretches to remove (SPAN), and the stretches, of its documents and of earlier
        ones, whose windows have to be compared one by one on account of this batch."""
        spark = self.spark
        rows = batch.select(*_identity("doc_id", "text"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
        hashed = materialize(rows.mapInArrow(_hash_batch, STRETCH), "stretches")
        new = hashed.where("not settled").select(*RUN)
        own = new.groupBy("fp").agg(F.count("*").alias("m"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        old = self.known(own)
        if old is None:
            old = spark.createDataFrame([], new.schema)
            shared = own.where("m > 1")
        else:
            old = materialize(old.groupBy("fp", "content").agg(F.min(F.struct(*SPAN)).alias("s")).select("fp", "content", "s.*"), "known")
            before = old.groupBy("fp").agg(F.min("content").alias("_lo"), F.max("content").alias("_hi"))
            both = own.join(before.hint("merge"), "fp", "left")
            shared = both.where("m > 1 or _lo is not null").select("fp", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"))
        shared = materialize(shared.select("fp", (F.col("lo") != F.col("hi")).alias("mixed")), "shared")
        judged = materialize(new.join(shared.hint("merge"), "fp", "left"), "judged")
        # of the stretches that share their fingerprint, the first of each content
        some = judged.where("mixed is not null")
        first = some.groupBy("fp", "content").agg(F.min("doc_id").alias("head"))
        seen = old.select("fp", "content", F.col("doc_id").alias("seen"))
        settled = first.join(seen.hint("merge"), ["fp", "content"], "left").select("fp", "content", F.least("head", "seen").alias("head"), F.col("seen").isNotNull().alias("seen"))
        ruled = materialize(some.join(settled.hint("merge"), ["fp", "content"]).select(*RUN, "mixed", "seen", (F.col("doc_id") > F.col("head")).alias("goes")), "ruled")
        kept = ruled.where("not goes")
        self.runs.append(self._write(judged.where("mixed is null").select(*RUN).unionByName(kept.where("not seen").select(*RUN)), 0))
        self._commit()
        self.compact()
        done_with(judged)
        gone = hashed.where("settled").select(*SPAN).unionByName(ruled.where("goes").select(*SPAN))
        # of earlier documents, what stands under a fingerprint that this batch has in other words
        alike = old.join(shared.where("mixed").select("fp").hint("merge"), "fp", "left_semi")
        compare = kept.where("mixed").select(*SPAN).unionByName(alike.select(*SPAN))
        return gone, compare


def _spans(starts: list, counts: list) -> np.ndarray:
    return np.unique(ranges(np.array(starts, np.int64), np.array(counts, np.int64)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of the windows to compare, of each document the first of equal ones. Those that also start in a smaller
    document of the chunk are settled: they go, and are dealt anywhere."""
    for batch in chunks(batches, limit=SMALL_CHUNK):
        batch = batch.filter(pc.is_valid(batch.column("spans")))
        words = Words(batch.column("text"))
        a, b = (window_hashes(words.hashes(seed), WINDOW, 1 + seed).view(np.int64) for seed in (0, 1))
        spans = [_spans([s["start"] for s in x or ()], [s["n"] for s in x or ()]) for x in batch.column("spans").to_pylist()]
        at = np.concatenate([s + base for s, base in zip(spans, words.starts)]) if spans else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        key = mix(a[at].view(np.uint64) ^ mix(b[at].view(np.uint64)))
        # what repeats within the document is found when it is cut
        once = np.ones(len(key), bool)
        with np.errstate(over="ignore"):
            often = repeated(mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = often[np.lexsort((often, key[often], row[often]))]
        once[order[1:][(key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])]] = False
        at, row, key = at[once], row[once], key[once]
        ids = _ids(batch)[row]
        a, b = a[at], b[at]
        settled, often = np.zeros(len(key), bool), repeated(key)
        _, group = np.unique(key[often], return_inverse=True)
        least = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[often])
        settled[often] = ids[often] > least[group]
        with np.errstate(over="ignore"):
            a = np.where(settled, mix(key + np.arange(len(key), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), a)
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(ids), batch.column("text_hash").take(pa.array(row)), pa.array(at - words.starts[row], pa.int32()), pa.array(settled)], names=["a", "b", *ROW, "start", "settled"])


def _cut(batch: pa.RecordBatch, text: str) -> tuple[Words, np.ndarray]:
    """The batch's words, and which of them go."""
    words = Words(batch.column(text))
    h = words.hashes()
    n = max(len(h) - WINDOW + 1, 0)
    # whole[i]: the window from word i on goes; first those that repeat within the document
    whole = np.zeros(len(h) + 1, np.int64)
    if n:
        inside = np.flatnonzero(words.left()[:n] >= WINDOW)
        w1, w2, doc = window_hashes(h, WINDOW, 1)[inside], window_hashes(words.hashes(1), WINDOW, 2)[inside], words.doc_of()[inside]
        with np.errstate(over="ignore"):
            often = repeated(mix(w1 + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        w1, w2, doc, inside = w1[often], w2[often], doc[often], inside[often]
        order = np.lexsort((inside, w2, w1, doc))
        same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        whole[inside[order[1:][same]]] = 1
    for base, spans in zip(words.starts.tolist(), batch.column("_spans").to_pylist()):
        if spans:
            whole[base + _spans([s["start"] for s in spans], [s["n"] for s in spans])] = 1
    delta = np.zeros(len(h) + 1, np.int64)
    np.add.at(delta, np.flatnonzero(whole), 1)
    np.add.at(delta, np.minimum(np.flatnonzero(whole) + WINDOW, len(h)), -1)
    return words, np.cumsum(delta)[: len(h)] > 0


def _digest_columns(batch: pa.RecordBatch, text: str) -> list[pa.Array]:
    words, gone = _cut(batch, text)
    removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), np.minimum(words.starts, len(gone))) * (words.counts > 0) if len(words.counts) else np.empty(0, np.int64)
    left = np.concatenate([[0], np.cumsum(words.counts - removed)])
    kept = words.dictionary.take(pa.array(words.codes[~gone]))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), " ")
    sha = [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()]
    changed = pc.if_else(pa.array(removed > 0), texts, pa.scalar(None, pa.string()))  # null: the text as it was
    return [pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string()), changed.cast(pa.string())]


def _identity(id_name: str, text_name: str) -> list[Column]:
    return [F.col(id_name).cast("long").alias("doc_id"), F.xxhash64(F.col(text_name).cast("string")).alias("text_hash")]


def removals(docs: DataFrame, batches: int = 2, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Per row with something to remove: doc_id, text_hash and `_spans`, an array of (start, n) runs of window starts. Windows that
    repeat only within their document are left to `remove`. `batches`: how many the documents are dealt into, by quantiles of the id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), F.col(text_name).alias("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    part = functools.reduce(lambda n, bound: n + (F.col("doc_id") > bound).cast("int"), bounds or [], F.lit(0))
    index = FingerprintIndex(spark)
    gone, compare = zip(*(index.add(rows.where(part == k)) for k in range(len(bounds or []) + 1)))
    index.close(keep=False)
    # rows that repeat id and text have one list of spans, without repeats
    todo = functools.reduce(DataFrame.unionByName, compare).groupBy(*(F.col(c).alias(f"_{c}") for c in ROW)).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    # a left join, as that of `remove`, so that both read one shuffle of the texts
    windows = docs.join(todo.hint("merge"), _same_row(id_name, text_name), "left").select(F.col("_doc_id").alias("doc_id"), F.col("_text_hash").alias("text_hash"), F.col(text_name).cast("string").alias("text"), "spans")
    windows = windows.mapInArrow(_compare, "a long, b long, doc_id long, text_hash long, start int, settled boolean")
    earliest = W.partitionBy("a", "b")  # a hot window has a row for each chunk of documents
    later = windows.withColumn("least", F.min("doc_id").over(earliest)).where("settled or doc_id > least").select(*ROW, "start", F.lit(1).alias("n"))
    for g in gone:
        later = later.unionByName(g)
    return later.groupBy(*ROW).agg(F.collect_list(F.struct("start", "n")).alias("_spans"))


def _same_row(id_name: str, text_name: str) -> Column:
    doc_id, text_hash = _identity(id_name, text_name)
    return (doc_id == F.col("_doc_id")) & (text_hash == F.col("_text_hash"))


def remove(docs: DataFrame, batches: int = 2) -> DataFrame:
    """`docs` with n_words, n_removed, kept_sha256 and kept_text (null where nothing goes) behind its columns."""
    m = Masked(docs)
    own_id, own_text = m.name("doc_id"), m.name("text")
    gone = removals(m.df, batches, own_id, own_text).withColumnsRenamed({c: f"_{c}" for c in ROW}).hint("merge")
    both = m.df.join(gone, _same_row(own_id, own_text), "left").drop(*(f"_{c}" for c in ROW))
    both, text = m.as_string(both, "text")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
    return m.restore(add_columns(both, fields, lambda: functools.partial(_digest_columns, text=text), text, SMALL_CHUNK), [f.name for f in fields])
