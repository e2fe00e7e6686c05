"""Connected components of a graph given by its edges, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of every vertex of `edges` (a, b): the label is the least id of its component.

    Alternates two star steps until nothing changes: every vertex's larger neighbours, then its smaller ones, are hung on its
    least neighbour. The number of edges never grows and a vertex's neighbours are never collected. Rounds are compared by number
    and sum of the hashes of their edges. Self loops and repeated edges do no harm; an empty graph has no vertices."""
    e = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = down.join(least(down), "u")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()
        e = checkpointed(small)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = e.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    return e.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(tops)
