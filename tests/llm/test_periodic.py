import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import periodic
from lectern.llm.queries import ORACLES, QUERIES
from tests import oracle
from tests.llm import data


def brute_runs(words, least=6):
    """Every maximal stretch of every period, by comparing all words; the smallest period of a stretch counts."""
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 4 * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def found(lists):
    counts = np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(counts) - counts
    codes = np.array([c for x in lists for c in x], np.int64)
    runs = [[] for _ in lists]
    for s, e, p in periodic.find_runs(codes, starts, counts):
        k = next(k for k in range(len(lists)) if starts[k] <= s < starts[k] + counts[k])
        runs[k].append((s - starts[k], e - s, p))
    return [sorted((int(a), int(b), int(c)) for a, b, c in r) for r in runs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_short_alphabets(lists):
    assert found(lists) == [brute_runs(x) for x in lists]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 60)), max_size=5))
def test_planted_runs(parts):
    words = list(itertools.chain.from_iterable((w * k)[:k] for w, k in parts))
    assert found([words]) == [brute_runs(words)]


def test_small_steps(monkeypatch):
    r = random.Random(3)
    lists = [[r.randint(0, 1) for _ in range(r.randint(0, 90))] for _ in range(40)]
    monkeypatch.setattr(periodic, "STEP", 16)
    monkeypatch.setattr(periodic, "_FIRST_LOOK", 2)
    assert found(lists) == [brute_runs(x) for x in lists]


def test_long_run_is_extended_once(monkeypatch):
    calls = []
    extend = periodic._extend
    monkeypatch.setattr(periodic, "_extend", lambda *a: calls.append(a) or extend(*a))
    assert found([[1, 2, 3] * 20_000]) == [[(0, 60_000, 3)]]
    assert len(calls) == 1


def test_odd_rows(spark):
    rows = [*data.odd_rows(), (20, "a b c " * 7 + "a"), (21, "x " * 6), (22, "x " * 5), (None, "y " * 9)]
    out = periodic.collapse(data.odd_docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = sorted((repr(r.doc_id), r.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in out)
    want = []
    for i, t in rows:
        w = data.words(t)
        runs = brute_runs(w) if len(w) < 5000 else []
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        want.append((repr(i), t or "", len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert periodic.collapse(data.empty_docs(spark)).count() == 0


def test_strongest(spark):
    rows = [([(0, 8, 2), (3, 20, 5), (9, 12, 3)],), ([],), ([(5, 6, 1), (40, 60, 9)],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in df.select(periodic.strongest(F.col("runs"))).collect()] == [(0, 8, 2), None, (40, 60, 9)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    oracle.check(spark, QUERIES["op13_periodic_runs"], ORACLES["op13_periodic_runs"], f"/root/testdata/{sf}")
