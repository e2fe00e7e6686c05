import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import spelling
from lectern.llm.queries import ORACLES, QUERIES
from tests import oracle
from tests.llm import data


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, o) for o, m in counts.items() if one_edit(w, o))
        out[w] = (near[0][1] if near and -near[0][0] >= 2 * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, counts[form] if form else None))
    return sorted(rows)


def words_of(r, n, letters, longest):
    return {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.randint(1, 60) for _ in range(n)}


@pytest.mark.parametrize("leaf", [512, 4, 1])
def test_against_all_pairs(spark, leaf):
    r = random.Random(leaf)
    counts = {**words_of(r, 150, "abc", 6), **words_of(r, 100, "aeinrstéüÿz", 8), "": 3, "x": 9, "日本": 2, "日本語": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(x) for x in spelling.variants(df, leaf=leaf).collect())
    assert got == brute(counts)


def test_hot_hub(spark):
    """One word that a third of the others is next to, and groups far over the leaf size."""
    r = random.Random(5)
    hub = "abcdefghij"
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {hub: 10_000}
    for i in range(10):
        for c in letters:
            counts.setdefault(hub[:i] + c + hub[i + 1 :], r.randint(3, 9))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(x) for x in spelling.variants(df, leaf=16).collect())
    assert got == brute(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "abbbbb": 96, "zzzzzz": 5, "zzzzzy": 10, "zzzzzx": 10, "lonely": 4}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {x.word: x for x in spelling.variants(df).collect()}
    assert got["aaaaaa"].root == "abbbbb" and got["aaaaaa"].form == "aaaaab"
    assert got["zzzzzz"].form == "zzzzzx" and got["zzzzzx"].form is None and got["lonely"].root == "lonely"
    assert sorted(tuple(x) for x in got.values()) == brute(counts)


def test_words_of_odd_rows(spark):
    rows = [*data.odd_rows(), (30, "ÀÉÿ×Straße HELLO hello's Ĳx")]
    runs = spelling.drop_letters(spelling.letter_runs(data.odd_docs(spark, rows)), every=3)
    import re

    want = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 3 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            want[w] += 1
    assert {r.word: r["count"] for r in runs.groupBy("word").count().collect()} == want
    assert spelling.variants(spelling.vocabulary(spelling.letter_runs(data.empty_docs(spark)).withColumnRenamed("run", "word"))).count() == 0


def test_one_edit_flips_two_bits_at_most(spark):
    r = random.Random(9)
    pairs = []
    for _ in range(200):
        w = "".join(r.choice("abcxyzàéÿß") for _ in range(r.randint(1, 9)))
        i = r.randrange(len(w))
        pairs += [(w, w[:i] + r.choice("aqé") + w[i + 1 :]), (w, w[:i] + w[i + 1 :]), (w, w[:i] + "k" + w[i:])]
    flips = spark.createDataFrame(pairs, "a string, b string").select(F.bit_count(spelling.parity_mask(F.col("a")).bitwiseXOR(spelling.parity_mask(F.col("b")))).alias("n"))
    assert flips.agg(F.max("n")).first()[0] <= 2


def test_query(spark):
    oracle.check(spark, QUERIES["op12_spelling_variants"], ORACLES["op12_spelling_variants"], "/root/testdata/sf0.01")
