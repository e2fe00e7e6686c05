import difflib
import random
import time

from pyspark.sql import functions as F

from lectern.functions import similarity as S


def test_matching_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x", ""), (None, "a"), ("same", "same")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.matching_ratio("a", "b").alias("r")).collect()
    for r in rows:
        if r.a is None:
            assert r.r is None
        else:
            assert abs(r.r - difflib.SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12


def test_replaced_tokens(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "b"], ["a", "x", "c"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.t for r in rows.select(S.replaced_tokens("a", "b").alias("t")).collect()] == [["b"], [], None]


def test_best_window(spark):
    rows = spark.createDataFrame([(["we", "met", "old", "mary", "there"], ["old", "marie"]), ([], ["a"]), (["a"], [])], "w array<string>, p array<string>")
    got = [r.s for r in rows.select(S.best_window(F.col("w"), F.col("p")).alias("s")).collect()]
    assert abs(got[0] - (1 - 2 / 9)) < 1e-12 and got[1:] == [0.0, 0.0]


def test_rewrite_spans(spark):
    spoken = {"New York": "NY", "York": "Y", "New": "N", "a b c": "abc"}
    texts = ["New York York New", "New", "", None, "a b a b c", "New  York", "York New York", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.rewrite_spans(F.col("t"), spoken).alias("s")).collect()
    assert [r.s for r in rows] == ["NY Y N", "N", "", None, "a b abc", "N  Y", "Y NY", "a b"]


def test_rewrite_of_long_texts_is_linear(spark):
    """A text of 200,000 words, against a fold in Python."""
    spoken = {"a b": "1", "b": "2", "a b c d": "3", "d (a": "4"}
    r = random.Random(1)
    words = [r.choice(["a", "b", "c", "d", "(a", "", "ab", "é\n"]) for _ in range(200_000)]
    want, i = [], 0
    while i < len(words):
        k = next((k for k in (4, 2, 1) if " ".join(words[i : i + k]) in spoken and i + k <= len(words)), 0)
        want.append(spoken[" ".join(words[i : i + k])] if k else words[i])
        i += k or 1
    start = time.perf_counter()
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(S.rewrite_spans(F.col("t"), spoken).alias("s")).first().s
    assert got == " ".join(want) and time.perf_counter() - start < 20
