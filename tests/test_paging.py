import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import paging


def brute(rows, most_rows, most_bytes):
    out, state = [], {}
    for key, order, size in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        page, ordinal, running = state.get(key, (1, 0, 0))
        if ordinal and (ordinal == most_rows or running + (size or 0) > most_bytes):
            page, ordinal, running = page + 1, 0, 0
        state[key] = page, ordinal, running = page, ordinal + 1, running + (size or 0)
        out.append((key, order, page, ordinal, running))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_rows,block,group", [(3, 4, 2), (5, 5, 1), (16, 1024, 1024), (1, 2, 3), (7, 16, 2)])
def test_pages_of_keys_over_many_blocks(spark, most_rows, block, group):
    r = random.Random(most_rows)
    rows = [(k, i * 3, r.choice([None, 0, 1, 5, 10, 29, 30, 31, 200])) for k, n in (("a", 130), ("b", 1), (None, 23), ("c", 64)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, s long")
    got = paging.fill_pages(df, "k", "o", "s", most_rows, 30, block, group)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows, most_rows, 30)
    assert paging.fill_pages(df.limit(0), "k", "o", "s", most_rows, 30, block, group).count() == 0


def test_one_hot_key(spark):
    """A million rows of one key, over many tasks: no task reads a large part of them behind the numbering."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("o"), (F.hash("id") % 3000 + 3000).cast("long").alias("s"))
    start = time.perf_counter()
    out = paging.fill_pages(df, "k", "o", "s", 16, 30_000)
    whole = out.agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.max("page").alias("last"), F.max("ordinal").alias("longest"), F.max("running").alias("largest")).first()
    assert whole.n == n and whole.pages == whole.last and whole.longest <= 16 and whole.largest <= 30_000
    assert time.perf_counter() - start < 120
    # a page ends only where the next row didn't fit
    sizes = [r.s for r in df.limit(3000).orderBy("o").select("s").collect()]
    want = brute([("hot", i, s) for i, s in enumerate(sizes)], 16, 30_000)
    got = out.where("o < 2900").collect()
    assert {tuple(x) for x in got} == {w for w in want if w[1] < 2900}


def test_numbers(spark):
    rows = [(k, i) for k in ("a", None, "b") for i in range(50)]
    got = paging.numbered(spark.createDataFrame(rows, "k string, o long").repartition(5), "k", ["o"], 7).collect()
    assert all(r.rn == r.o for r in got) and len(got) == 150


def test_quantiles(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, *range(9)]) if k != "one" else 7.5) for k in ["a", "b", None] * 60 + ["one"]]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows] + [("none", None)], "k string, v double").repartition(5)
    got = {x.k: (x.lo, x.mid, x.top) for x in paging.quantiles(df, "k", "v", {"lo": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    import numpy as np

    want = {k: tuple(float(np.quantile([v for j, v in rows if j == k and v is not None], q)) for q in (0.25, 0.5, 1.0)) for k in {k for k, _ in rows}}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
