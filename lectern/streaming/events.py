"""Event streams: windowed counts, sessions and bounded retries, each the same function over a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import latest
from ..session import work_dir

#: Events later than this behind the latest one seen are dropped by a stream of sessions. A table has no late events.
LATE = "40 days"
MOST_ATTEMPTS = 2


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """`ts` as a time; one without a zone is read as UTC, whatever the session's zone."""
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return events.withWatermark("ts", late) if late and events.isStreaming else events


def tumbling(events: DataFrame, width: str, keys: list[str]) -> DataFrame:
    """Count and sum of `value` in hundredths of each window and key; the partial sums are made before the shuffle. A
    stream drops no late event: update mode needs no watermark, and the state is a row for each window and key."""
    cents = F.round(F.col("value") * 100).cast("long")
    counted = _timed(events, None).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    return counted.select(F.unix_timestamp("window.start").alias("start_s"), *keys, "n", "cents")


def sessions(events: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Sessions of each key: an event `gap` or more behind the last one opens a new one."""
    counted = _timed(events, LATE).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"), F.min("value").alias("least"))
    return counted.select(*keys, F.unix_timestamp("session_window.start").alias("start_s"), "n", "least")


def retries(failures: DataFrame) -> DataFrame:
    """Per user how many failures were queued again and how many were beyond the budget. A user's state is its count, kept by the
    engine; partial counts are made before the shuffle."""
    counted = failures.groupBy("user_id").agg(F.count("*").alias("total"))
    queued = F.least(F.col("total"), F.lit(MOST_ATTEMPTS).cast("long"))
    return counted.select("user_id", queued.alias("queued"), (F.col("total") - queued).alias("exhausted"))


def settle(stream: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Run a stream over all its input in update mode, and return the last row of each key. Each batch has a folder of its own, so
    that a batch that is run again after a failure replaces its rows."""
    spark = stream.sparkSession
    folder = work_dir(spark, what)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return latest(rows, keys, [F.desc("batch")]).select(stream.columns)
