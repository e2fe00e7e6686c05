import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, forest, jaccard, topk
from lectern.llm.queries import ORACLES, QUERIES
from tests import oracle

from .data import empty_docs, odd_docs, odd_rows, prose, words


def brute_classes(rows, by_shingle=False):
    """Class and links of each id. `by_shingle`: of pairs that share a shingle, which are all that can be similar."""
    sets = {}
    for i, t in rows:
        w = tuple(words(t))
        if w and i is not None:
            sets[i] = (w, {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w})
    label = {i: i for i in sets}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i][0], i)
    links = dict.fromkeys(first.values(), 0)

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    pairs = itertools.combinations(sorted(first.values()), 2)
    if by_shingle:
        texts = {}
        for i in sorted(first.values()):
            for g in sets[i][1]:
                texts.setdefault(g, []).append(i)
        pairs = sorted({p for x in texts.values() for p in itertools.combinations(x, 2)})
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        if len(x & y) >= 0.8 * len(x | y):
            links[a] += 1
            links[b] += 1
            u, v = top(a), top(b)
            label[max(u, v)] = min(u, v)
    out = {i: (top(first[s[0]]), links[first[s[0]]]) for i, s in sets.items()}
    return out | {i: (i, 0) for i, t in rows if i is not None and not words(t)}


@pytest.fixture(scope="module")
def many():
    """Copies, near copies of growing distance, and one group larger than a block."""
    rows = odd_rows()
    base = prose(200, 50).split()
    for k in range(300):
        rows.append((100 + k, " ".join(base[: k % 40] + ["w%d" % k] + base[k % 40 + 1 :]) if k % 3 else " ".join(base)))
    for k in range(12):
        rows.append((500 + k, " ".join(base[: 200 - 8 * k])))
    return rows


def test_join_against_brute_force(spark, many, monkeypatch):
    got = jaccard.similar(odd_docs(spark, many)).collect()
    assert len(got) == len(many)
    want = brute_classes(many)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == want
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]


@pytest.mark.parametrize("name, value", [("BLOCK", 40), ("BLOCK_BYTES", 20_000), ("PAIRS", 50), ("TOGETHER", 5_000), ("TARGET", 0.0), ("TARGET", 1.0), ("LEAST_DEPTH", jaccard.DEPTH)])
def test_limits_agree(spark, many, monkeypatch, name, value):
    """The limits of tasks, and how far prefixes are shortened, change no result here."""
    monkeypatch.setattr(jaccard, name, value)
    got = jaccard.similar(odd_docs(spark, many), sure=0.0 if name == "BLOCK" else jaccard.SURE).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == brute_classes(many)


def test_ids_with_several_texts(spark):
    """Contents are told apart by their words, not by an id that rows share; equal over several runs."""
    a, b = prose(120, 1).split(), prose(130, 2).split()
    near = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 50)), (3, near(b, 60)), (1, " ".join(a)), (4, " \n".join(a)), (5, prose(50, 3))]
    want = Counter([(1, 1, 1)] * 3 + [(2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 5, 0)])
    for n in (1, 3, 5):
        got = jaccard.similar(odd_docs(spark, rows).repartition(n)).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
        assert Counter(r.doc_id for r in got if r["first"]) == {1: 3, 5: 1}  # (1, a) twice and (1, b)


def test_groups_over_many_batches(spark, many, monkeypatch):
    """Groups that come in many Arrow batches are whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = jaccard.similar(odd_docs(spark, many)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == brute_classes(many)


def test_recall_against_all_pairs_that_share_shingles(spark):
    """At sf0.01, against each pair of different texts with a shingle in common that few texts have."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar(docs).collect()}
    want = brute_classes([tuple(r) for r in docs.collect()], by_shingle=True)
    links = sum(n for _, n in want.values())
    assert sum(min(n, want[i][1]) for i, (_, n) in got.items()) >= 0.99 * links > 0
    assert all(n <= want[i][1] for i, (_, n) in got.items())


def test_registered_join(spark):
    got = QUERIES["op2_ngram_jaccard_join"](spark, oracle.SF)
    assert got.columns == ["doc_id", "class_id", "n_links"]
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == brute_classes(rows, by_shingle=True)


def brute_leaves(contents, depth, least, crowd):
    out = set()
    for tree in range(forest.TREES):
        paths = {i: t[tree * 4 * depth : (tree + 1) * 4 * depth] for i, _, t in contents}
        sizes = {i: z for i, z, _ in contents}
        for i, p in paths.items():
            for d in range(least, depth + 1):
                node = [j for j, q in paths.items() if q[: 4 * d] == p[: 4 * d]]
                if len(node) <= crowd or d == depth:
                    break
            if len(node) > 1:
                out.add((i, tree, len(node), sum(sizes[j] for j in node), min(node)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("crowd", [1, 4, 1000])
def test_leaves_of_sorted_signatures(spark, parts, crowd):
    """Nodes that lie over many ranges, whole ranges of one node among them, against all signatures."""
    r = random.Random(parts)
    depth, least = 5, 2
    word = lambda n: r.randrange(n).to_bytes(4, "little")
    few = [b"".join(word(2 if k < 3 else 5) for k in range(depth * forest.TREES)) for _ in range(60)]
    same = [bytes(4 * depth * forest.TREES)] * 50
    contents = [(i, 10 + i, t) for i, t in enumerate(few + same)]
    d = spark.createDataFrame(contents, "id long, size long, trees binary").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = forest.leaves(d, depth, least, 0.8, 1.0, (crowd,))[0].collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by_key = {}
    for x in rows:
        by_key.setdefault(x.key, []).append(x.id)
    assert all(len(v) == x.m for x in rows for v in [by_key[x.key]])
    assert {(x.id, x.key & 15, x.m, x.bytes, min(by_key[x.key])) for x in rows} == brute_leaves(contents, depth, least, crowd)


def test_prefixes_are_shortened_until_the_target(spark):
    """The bound of a leaf is the least that reaches the target recall."""
    contents = [(i, 1, b"".join((i if k % 5 == 4 else 0).to_bytes(4, "little") for k in range(5 * forest.TREES))) for i in range(30)]
    d = spark.createDataFrame(contents, "id long, size long, trees binary")
    deep = forest.leaves(d, 5, 2, 0.8, 0.99, (8, 16, 32))[0].count()  # 0.998 at the longest prefix, which nobody shares
    short = forest.leaves(d, 5, 2, 0.8, 0.9999, (8, 16, 32))[0].collect()
    assert deep == 0 and len(short) == 30 * forest.TREES and {x.m for x in short} == {30}


def test_depth_meets_recall():
    d = jaccard.depth_for()
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


def test_join_on_nothing(spark):
    assert jaccard.similar(empty_docs(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 90), (90, 95), (7, 7), (95, 90)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 90 for k in (90, 95, 100)}


def test_topk_query_against_sql(spark):
    oracle.check(spark, QUERIES["op5_topk_search"], ORACLES["op5_topk_search"])


def test_topk_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, -1.0]), (1, [1.0, 2.0, -1.0]), (2, [0.5, None, 1.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (5, None), (6, []), (7, [3.0, 1.0]), (8, [2.0, 2.0, 2.0]), (9, [-1.0, -1.0, -1.0]), (None, [9.0, 9.0, 9.0]), (10, [1.0, 2.0, -1.0]), (10, [5.0, 5.0, 5.0])]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(d, F.col("vec_id") == 0).collect()}
    fine = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 3 and all(x is not None and x == x and abs(x) < inf for x in v)]
    q = dict(fine)[0]
    want = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in fine if i != 0))[:5]
    assert got == {(0, k + 1): (i, -s) for k, (s, i) in enumerate(want)}


def test_topk_on_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_queries_that_share_an_id(spark):
    """Two vectors under one id are two queries, each with a list of k of its own; equal rows are one."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.5, 0.1]), (2, [0.1, 0.5]), (3, [0.25, 0.25])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") == 0, 2).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.rank):
        lists.setdefault(r.query_hash, []).append(r.vec_id)
    assert sorted(lists.values()) == [[1, 3], [2, 3]]


@pytest.mark.parametrize("dense", [1, 64, 1 << 40])
def test_topk_by_products_and_by_pairs(monkeypatch, dense):
    """However many pairs are left, the same best rows, ties to the smaller id."""
    monkeypatch.setattr(topk, "DENSE", dense)
    g = np.random.default_rng(7)
    v = np.concatenate([g.integers(-300, 300, (900, 64)), np.zeros((40, 64), int), g.integers(-2, 3, (60, 64))]).astype(np.int64)
    v[100:130], ids = v[99], g.permutation(1000).astype(np.int64)
    best = topk._Best(ids[::9], v[::9], 5)
    for a in range(0, 1000, 300):
        x = v[a : a + 300]
        best.meet(ids[a : a + 300], x, {s: topk._statistics(x.astype(float), s) for s in topk.RESOLUTIONS})
    want = [sorted((-int(q @ x), int(j)) for j, x in zip(ids, v) if j != i)[:5] for i, q in zip(ids[::9], v[::9])]
    assert best.found == want
