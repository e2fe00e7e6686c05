"""Streaming queries, run over all events there are, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..streaming import events as E
from .registry import query, table


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return ship(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf}/events*.parquet")


_TUMBLING = """SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS start_s, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"""


@query("event_windows", _TUMBLING)
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.tumbling(table(spark, sf, "events"), "6 hours", ["event_type"])


@query("stream_tumbling", _TUMBLING)
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return E.settle(E.tumbling(_stream(spark, sf), "6 hours", ["event_type"]), ["start_s", "event_type"], "tumbling")


@query("event_sessions", """WITH l AS (SELECT user_id, ts, event_id, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    s AS (SELECT user_id, ts, value, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM l)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(count(*) AS BIGINT) AS n, min(value) AS least FROM s GROUP BY user_id, g""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return E.sessions(table(spark, sf, "events"), "6 hours", ["user_id"])


@query("stream_retries", """SELECT user_id, CAST(least(count(*), 2) AS BIGINT) AS queued, CAST(count(*) - least(count(*), 2) AS BIGINT) AS exhausted FROM events WHERE event_type = 'error' GROUP BY user_id""")
def stream_retries(spark: SparkSession, sf: str) -> DataFrame:
    return E.settle(E.retries(_stream(spark, sf).where(F.col("event_type") == "error")), ["user_id"], "retries")
