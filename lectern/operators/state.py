"""Lifecycle operators: new state as a function of old state and requests, written as whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import work_dir


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order` (upsert, latest wins)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def consume_once(requests: DataFrame, journal: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Requests that the journal hasn't seen, each key once."""
    return latest(requests.join(journal.select(*key).distinct(), key, "left_anti"), key, order)


def replace_partition(old: DataFrame, new: DataFrame, scope: list[str], replaced: Column) -> DataFrame:
    """`old` without the rows that `replaced` names in the scopes of `new`, and `new`."""
    touched = new.select(*scope).distinct().withColumn("_t", F.lit(True))
    kept = old.join(touched, scope, "left").where(F.col("_t").isNull() | ~F.coalesce(replaced, F.lit(False))).drop("_t")
    return kept.unionByName(new)


def retry_split(rows: DataFrame, attempts: Column, done: Column, most: int) -> DataFrame:
    """`decision`: idempotent where the request was done, exhausted at `most` attempts, else queued with one attempt more."""
    decision = F.when(done, "idempotent").when(attempts >= most, "exhausted").otherwise("queued")
    return rows.withColumn("decision", decision).withColumn("next_attempts", (attempts + F.when(F.col("decision") == "queued", 1).otherwise(0)).cast("long"))


def illegal_transitions(events: DataFrame, keys: list[str], order: list[str], state: str, legal: DataFrame) -> DataFrame:
    """Events whose state may not follow the one before. `legal` has (src, dst); src '' is the start."""
    w = W.partitionBy(*keys).orderBy(*order)
    steps = events.withColumn("src", F.coalesce(F.lag(state).over(w), F.lit(""))).withColumn("dst", F.col(state))
    return steps.join(F.broadcast(legal), ["src", "dst"], "left_anti")  # legal: a fixed machine's few pairs


def claim(queue: DataFrame, worker: list[str], mine: Column, order: list[str]) -> DataFrame:
    """Per worker: its own running row if there is one, else the oldest queued."""
    return latest(queue, worker, [F.when(mine, 0).otherwise(1).asc(), *map(F.col, order)])


def repair_rounds(rows: DataFrame, bad: Column, repair: Callable[[DataFrame, int], DataFrame], most_attempts: int) -> DataFrame:
    """Check, repair what fails, and check again what was repaired, and only that, until nothing fails or a row has been repaired
    `most_attempts` times. Returns `rows`' columns as they were judged, with attempt (from 1) and status: PASS, REPAIR (the row goes into the next
    round), or EXHAUSTED. A row whose check is null fails it.

    `repair(failed, attempt)` returns the rows with the same columns. A round's frontier is written, so that the next starts from
    it and lost executors cost no earlier round; there are at most most_attempts + 1 rounds, each over what the last one repaired."""
    rounds, frontier = [], rows
    for attempt in range(1, most_attempts + 2):
        last = attempt > most_attempts
        failed = F.coalesce(bad, F.lit(True))
        judged = frontier.withColumns({"attempt": F.lit(attempt), "status": F.when(~failed, "PASS").otherwise("EXHAUSTED" if last else "REPAIR")})
        path = work_dir(rows.sparkSession, "repair-round")
        judged.write.parquet(path)
        judged = rows.sparkSession.read.schema(judged.schema).parquet(path)
        rounds.append(judged)
        again = judged.where("status = 'REPAIR'").drop("attempt", "status")
        if last or again.isEmpty():
            break
        frontier = repair(again, attempt)
    return functools.reduce(DataFrame.unionByName, rounds)
