"""Bags and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bag_difference(after: DataFrame, before: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of `after` beyond the times that their key occurs in `before`; the earlier ones count as the old ones."""
    had = before.groupBy(*keys).agg(F.count("*").alias("_had"))
    marked = after.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return marked.join(had, keys, "left").where(F.col("_n") > F.coalesce("_had", F.lit(0))).drop("_n", "_had")


def compare(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: added, removed, changed or same."""
    b, a = before.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), after.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    kind = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return b.join(a, key, "full_outer").withColumn("change", kind).select(*key, "change")
