import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F

from lectern.llm import langid, quality_bayes

from .data import empty_docs, odd_docs, odd_rows, prose, words
from .test_formats import reference_ids
from .test_models import brute_language, brute_sites
from .test_rules_and_substring import brute_substring
from .test_similarity import brute_classes

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def test_stage_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), SF).columns == docs.columns, name


def test_toxic_and_bad_documents_go(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in STAGES["quality classifier"](spark, docs, SF).select("doc_id").collect()}
    rows = labels.collect()
    clean = [r.doc_id for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(r.doc_id in kept for r in rows if r.quality == 0) <= 3


def test_one_of_each_class_stays(spark):
    rows = odd_rows()
    kept = STAGES["n-gram Jaccard join"](spark, odd_docs(spark), SF).select("doc_id").collect()
    want = {i for i, (c, _) in brute_classes(rows).items() if c == i}
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == sorted(want)
    assert sum(r.doc_id is None for r in kept) == 1


def test_rows_of_one_id_with_different_texts_stay(spark):
    a, b = prose(120, 1), prose(130, 2)
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (None, a), (None, a)]
    for n in (1, 4):
        kept = STAGES["n-gram Jaccard join"](spark, odd_docs(spark, rows).repartition(n), SF).select("doc_id", "text").collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (1, b), (0, a), (0, a)])


def test_repeated_passages_go(spark):
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    got = STAGES["substring dedup"](spark, odd_docs(spark), SF).where("doc_id is not null").collect()
    left = {}
    for i, n, removed, _ in brute_substring(odd_rows()):
        if i is not None and (n == 0 or removed < n):
            left[i] = n - removed
    assert {r.doc_id: len(words(r.text)) for r in got} == left
    for r in got:
        assert r.text in {t for i, t in rows if i == r.doc_id} or r.n_chars == len(r.text)


def test_rows_of_one_id_keep_their_own_words(spark):
    """(5, b) is like nobody, though another row of its id is a copy."""
    a, b = prose(60, 21), prose(60, 22)
    docs = odd_docs(spark, [(1, a), (5, a), (5, b)])
    for stage in ("n-gram Jaccard join", "substring dedup"):
        docs = STAGES[stage](spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, a), (5, b)]


def kept_words(rows):
    """Texts without the windows that start in a smaller document or earlier in their own."""
    first, out = {}, {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 19):
            first[tuple(w[k : k + 20])] = min(first.get(tuple(w[k : k + 20]), i), i)
    for i, t in rows:
        w, own, gone = words(t), set(), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in own or first[g] < i:
                gone |= set(range(k, k + 20))
            own.add(g)
        if gone:
            t = " ".join(x for k, x in enumerate(w) if k not in gone)
        if not gone or t:
            out[i] = t
    return out


def test_run_against_brute_force(spark):
    """Every stage of a whole run, each on what the one before is to leave, by plain versions of all five."""
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = quality_bayes.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    odds = model.log_odds(pa.array([r.text for r in table], pa.string()))
    sites = [brute_sites([(r.source, r.lang, 1 / (1 + math.exp(-v))) for r, v in zip(table, x)]) for x in odds]
    rows = [r for i, r in enumerate(table) if max(x[i] + site[r.source, r.lang] for x, site in zip(odds, sites)) < 0]
    # the language model is the stage's own, learned from what is left
    left = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    spoken = langid.fit(left.where(~langid.held_out(F.col("doc_id"), 3)))
    with_main = []
    for r in rows:
        if any(c.isalpha() for c in r.text or ""):
            share, _ = brute_language(r.text, spoken)
            if max(share.values()) >= corpus_pipeline.LEAST_LANGUAGE_SHARE:
                with_main.append((r.doc_id, r.text))
    heads = {i for i, (c, _) in brute_classes(with_main, by_shingle=True).items() if c == i}
    texts = kept_words([(i, t) for i, t in with_main if i in heads])
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert got.keys() == texts.keys() and 50 < len(got) < len(table)
    for i, pieces in got.items():
        ids, at = reference_ids(texts[i]), 0
        for start, length, crc, whole in sorted(pieces):
            assert (start, whole, crc) == (at, len(ids), zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()))
            at += length
        assert at == len(ids)


def test_stages_on_nothing(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), SF).count() == 0, name


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n <> end or n > 4096").count() == 0 and out.count() > 50
