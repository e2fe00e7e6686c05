"""Greedy paging of ordered rows, with a key's rows spread over many tasks.

Where a page begins depends on all pages before it, so a plain fold has to see a key's rows one by one. Here a key's rows are numbered and cut
into blocks. Of a block it is found, for every place where a page may come in (a page that began before reaches at most its row
bound into the block), where the page behind its last one begins, and how many pages that makes. These small tables are put
together along the key, block by block within a group of blocks, then group by group; then each block knows where its own first
page begins, and pages are written block by block. No task holds more than a block, or the tables of a group."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import work_dir

#: Rows of a block, and blocks whose tables are put together in one step.
BLOCK, GROUP = 1024, 1024


def _written(df: DataFrame) -> DataFrame:
    path = work_dir(df.sparkSession, "paging")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """`rows` with `rn`, the place of each in its key's order, from 0. Rows are dealt into even ranges of (key, order), numbered within
    them and shifted by the counts of the ranges before, so that a key's rows don't go to one task."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _written(rows.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    # one row for each key and range that has it
    below = counts.withColumn("_below", F.sum("_n").over(W.partitionBy(key).orderBy("_range")) - F.col("_n")).select(F.col(key).alias("_key"), F.col("_range").alias("_of"), "_below")
    own = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_range", key).orderBy(*order)) - 1)
    both = own.join(below, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return both.withColumn("rn", (F.col("_at") + F.col("_below")).cast("long")).drop("_range", "_at", "_key", "_of", "_below")


def _follow(table: Column, x: Column) -> Column:
    """What a block's table makes of a page that comes in at x.at after x.pages pages."""
    hit = F.get(table, x["at"])
    return F.struct(hit["at"].alias("at"), (x["pages"] + hit["pages"]).alias("pages"))


def fill_pages(rows: DataFrame, key: str, order: str, size: str, most_rows: int, most_bytes: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """`rows` (key, order, size) with page (from 1), ordinal in it and running size: each page takes rows as long as neither bound is
    passed, a row over the bound alone. Sizes are not negative; a missing one counts 0. A null key is a key. `order` is unique in a key."""
    block = max(block, most_rows)
    names, key, order = (key, order), "_k", "_o"
    n = numbered(rows.select(F.col(names[0]).alias(key), F.col(names[1]).alias(order), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")), key, [order])
    n = n.withColumns({"_block": F.expr(f"rn div {block}"), "_i": (F.col("rn") % block).cast("int")})
    # a block has its own rows, and as many of the next as a page can reach
    reach = F.when((F.col("_i") < most_rows) & (F.col("_block") > 0), F.array(F.struct("_block", "_i"), F.struct((F.col("_block") - 1).alias("_block"), (F.col("_i") + block).alias("_i"))))
    n = n.withColumn("_p", F.explode(F.coalesce(reach, F.array(F.struct("_block", "_i"))))).select(key, order, "_size", "_p.*")
    cum = F.sum("_size").over(W.partitionBy(key, "_block").orderBy("_i"))
    b = n.withColumn("_cum", cum).groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct("_i", F.col(order).alias("o"), F.col("_size").alias("s"), F.col("_cum").alias("c")))).alias("rows"))
    b = b.withColumn("own", F.least(F.size("rows"), F.lit(block)))
    before = lambda i: F.get("rows", i)["c"] - F.get("rows", i)["s"]
    taken = lambda i: F.greatest(F.lit(1), F.size(F.filter(F.slice("rows", i + 1, F.lit(most_rows)), lambda r: r["c"] - before(i) <= most_bytes)))
    b = _written(b.withColumn("steps", F.transform(F.sequence(F.lit(0), F.col("own") - 1), taken)))

    # from the last row to the first: where the page behind the block's last one begins, for the most_rows places in front
    place = "array<struct<at:int,pages:long>>"
    state = F.struct(F.lit(0).alias("seen"), F.array().cast(place).alias("next"))

    def back(acc: Column, step: Column) -> Column:
        over = F.struct((step - acc["seen"] - 1).alias("at"), F.lit(1).cast("long").alias("pages"))
        hit = F.get(acc["next"], step - 1)
        own = F.when(step > acc["seen"], over).otherwise(F.struct(hit["at"].alias("at"), (hit["pages"] + 1).alias("pages")))
        return F.struct((acc["seen"] + 1).alias("seen"), F.slice(F.concat(F.array(own), acc["next"]), 1, most_rows).alias("next"))

    tables = b.select(key, "_block", F.expr(f"_block div {group}").alias("_group"), F.aggregate(F.reverse("steps"), state, back, lambda acc: acc["next"]).alias("table"))
    tables = _written(tables.groupBy(key, "_group").agg(F.array_sort(F.collect_list(F.struct("_block", "table"))).alias("blocks")))
    entries = F.transform(F.sequence(F.lit(0), F.lit(most_rows - 1)), lambda e: F.struct(e.alias("at"), F.lit(0).cast("long").alias("pages")))
    whole = tables.select(key, "_group", F.aggregate("blocks", entries, lambda acc, x: F.transform(acc, lambda a: _follow(x["table"], a))).alias("table"))

    def along(items: Column, first: Column, name: str) -> Column:
        """(name, at, pages) in front of each of the items."""
        start = F.struct(first.alias("now"), F.array().cast(f"array<struct<{name}:long,at:int,pages:long>>").alias("out"))
        step = lambda acc, x: F.struct(_follow(x["table"], acc["now"]).alias("now"), F.concat(acc["out"], F.array(F.struct(x[name].alias(name), acc["now"]["at"].alias("at"), acc["now"]["pages"].alias("pages")))).alias("out"))
        return F.aggregate(items, start, step, lambda acc: acc["out"])

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("pages"))
    groups = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_group", "table"))).alias("groups"))
    groups = groups.select(F.col(key).alias("_key"), F.explode(along(F.col("groups"), zero, "_group")).alias("x")).select("_key", F.col("x._group").alias("_of"), F.struct("x.at", "x.pages").alias("first"))
    blocks = _joined(tables, groups, key, "_group").select(key, F.explode(along(F.col("blocks"), F.col("first"), "_block")).alias("x"))
    blocks = blocks.select(F.col(key).alias("_key"), F.col("x._block").alias("_of"), F.col("x.at").alias("at"), F.col("x.pages").alias("pages"))

    page = "array<struct<from:int,rows:int>>"
    marks = F.aggregate(
        "steps", F.struct(F.lit(0).alias("i"), F.col("at").alias("next"), F.array().cast(page).alias("out")),
        lambda acc, step: F.struct((acc["i"] + 1).alias("i"), F.when(acc["i"] == acc["next"], acc["i"] + step).otherwise(acc["next"]).alias("next"), F.when(acc["i"] == acc["next"], F.concat(acc["out"], F.array(F.struct(acc["i"].alias("from"), step.alias("rows"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    pages = _joined(b, blocks, key, "_block").select(key, "rows", "pages", F.posexplode(marks).alias("k", "p"))
    head = F.get("rows", F.col("p.from"))
    out = pages.select(key, (F.col("pages") + F.col("k") + 1).alias("page"), (head["c"] - head["s"]).alias("base"), F.posexplode(F.slice("rows", F.col("p.from") + 1, F.col("p.rows"))).alias("j", "r"))
    return out.select(F.col(key).alias(names[0]), F.col("r.o").alias(names[1]), "page", (F.col("j") + 1).cast("long").alias("ordinal"), (F.col("r.c") - F.col("base")).alias("running"))


def _joined(left: DataFrame, right: DataFrame, key: str, number: str) -> DataFrame:
    same = [F.col(key).eqNullSafe(F.col("_key")), F.col(number) == F.col("_of")]
    return left.join(right, functools.reduce(Column.__and__, same)).drop("_key", "_of")


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, and a column for each name in `shares`): exact quantiles of each key's values, interpolated between neighbours. Values are numbered
    over many tasks and those on either side of a quantile looked up, so that no task holds a key's values. Null values don't count; a key
    without any is not returned."""
    own = numbered(rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v")), "_k", ["_v"])
    own = _written(own)
    n = own.groupBy("_k").agg(F.count("*").alias("n"))
    wanted = n.select(F.col("_k").alias("_key"), F.explode(F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * share).alias("at")) for name, share in shares.items()))).alias("x")).select("_key", "x.*")
    near = wanted.withColumn("_of", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    hit = own.join(near, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("rn") == F.col("_of")))
    both = hit.groupBy("_k", "name", "at").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    both = both.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at")))
    return both.groupBy(F.col("_k").alias(key)).agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares))
