"""Order-dependent operators. Each is one window over (keys, order), so one shuffle by the keys; keys are a job's or a document's,
whose rows fit a task's sort. `order` must be a total order for results to be defined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timeline(rows: DataFrame, keys: list[str], order: list[str], duration: Column, valid: Column) -> DataFrame:
    """`start` and `end` of each row: durations of the valid rows before it, and its own. Invalid rows don't advance time."""
    w = W.partitionBy(*keys).orderBy(*order)
    length = F.when(valid, duration).otherwise(0)
    out = rows.withColumn("end", F.sum(length).over(w))
    return out.withColumn("start", F.col("end") - length)


def gaps(rows: DataFrame, keys: list[str], order: list[str], before: Column, after: Column) -> DataFrame:
    """`gap` before each row: the larger of what the row before wants after it and what this one wants before it; the first row
    takes its own. `tail`: what the last row wants behind it."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = rows.withColumns({"_before": before, "_after": after})
    out = out.withColumn("gap", F.greatest(F.coalesce(F.lag("_after").over(w), F.col("_before")), F.col("_before")))
    return out.withColumn("tail", F.when(F.lead("_after").over(w).isNull(), F.col("_after")).otherwise(0)).drop("_before", "_after")


def longest_run(rows: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Per key the length of the longest run of consecutive rows with the flag, and the number of runs."""
    w, per_flag = W.partitionBy(*keys).orderBy(*order), W.partitionBy(*keys, "_f").orderBy(*order)
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    island = marked.withColumn("_i", F.row_number().over(w) - F.row_number().over(per_flag)).where("_f")
    runs = island.groupBy(*keys, "_i").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows whose value is not that of the row before (null is a value)."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumns({"_v": value, "_first": F.row_number().over(w) == 1})
    return marked.withColumn("_p", F.lag("_v").over(w)).where("_first or not (_v <=> _p)").drop("_v", "_p", "_first")


def fill_page(rows: DataFrame, keys: list[str], order: list[str], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """The rows of each key's first page: at most so many rows, whose sizes add up to at most so much."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= most_rows)  # most are gone before the shuffle
    return first.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most_bytes)


#: Elements of a long array that are folded together.
_BLOCK = 512


def _ends(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Where the units of an array end (counted from 1), by a fold that holds the length of an open unit, or null. `step(acc, item)`
    gives the ends that an item makes and what is held behind it; acc has `at`, the items before, and `held`.

    Folded block by block, and over numbers alone, so that no array grows by one element at a time beyond a block."""
    blocks = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))
    none = F.array().cast("array<int>")

    def one(acc: Column, x: Column) -> Column:
        ended, held = step(acc, x)
        return F.struct((acc["at"] + 1).alias("at"), held.alias("held"), F.concat(acc["out"], ended).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("held"), none.alias("out"), F.array().cast("array<array<int>>").alias("done"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), acc["held"].alias("held"), none.alias("out")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), r["held"].alias("held"), none.alias("out"), F.concat(acc["done"], F.array(r["out"])).alias("done")))[0]

    last = lambda acc: F.concat(F.flatten(acc["done"]), F.array_compact(F.array(F.when(acc["held"].isNotNull(), acc["at"]))))
    whole = lambda xs: F.aggregate(F.coalesce(blocks(xs), F.array().cast(f"array<array<{kind}>>")), start, block, last)
    return F.transform(F.array(items), whole)[0]


def merged_ends(lengths: Column, calm: Column, most: int, hold: int) -> Column:
    """Ends of the units of an array of strings, by greedy merge: a calm string is joined to the one held back while both have at most
    `most` characters together, with a blank between; a calm one under `hold` characters is held back, anything else is handed on as
    it stands."""

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        joins = x["calm"] & acc["held"].isNotNull() & (acc["held"] + x["n"] + 1 <= most)
        holds = x["calm"] & (x["n"] < hold)
        ended = F.when(joins, F.array().cast("array<int>")).otherwise(F.array_compact(F.array(F.when(acc["held"].isNotNull(), acc["at"]), F.when(~holds, acc["at"] + 1))))
        return ended, F.when(joins, acc["held"] + x["n"] + 1).when(holds, x["n"])

    return _ends(F.arrays_zip(lengths.alias("n"), calm.alias("calm")), "struct<n:int,calm:boolean>", step)


def short_ends(lengths: Column, most: int, hold: int) -> Column:
    """Ends of the units of an array of strings, by greedy merge: the open unit takes the next string if it has under `hold` characters and
    both together, with a blank between, have at most `most`; else the next string opens a unit."""

    def step(acc: Column, n: Column) -> tuple[Column, Column]:
        joins = acc["held"].isNotNull() & (acc["held"] < hold) & (acc["held"] + n + 1 <= most)
        return F.array_compact(F.array(F.when(acc["held"].isNotNull() & ~joins, acc["at"]))), F.when(joins, acc["held"] + n + 1).otherwise(n)

    return _ends(lengths, "int", step)


def joined(parts: str, ends: str) -> Column:
    """The units of the array column `parts` that end at the places in the array column `ends`, each joined by blanks."""
    begin = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    return F.transform(ends, lambda end, i: F.array_join(F.slice(parts, begin(i) + 1, end - begin(i)), " "))
