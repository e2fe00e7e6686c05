"""Queries over whole tables whose shorter kin keep a first part only."""

import pyarrow.parquet as pq
import pytest

from lectern.plans import ORACLES, QUERIES
from lectern.streaming import events as E
from tests import oracle

SF = "/root/testdata/sf0.01"


def test_every_event_has_its_page(spark):
    oracle.check(spark, QUERIES["keyset_pages"], ORACLES["keyset_pages"], SF)
    assert QUERIES["keyset_pages"](spark, SF).count() == pq.read_metadata(f"{SF}/events.parquet").num_rows


@pytest.mark.parametrize("name", ["redact_secrets", "redact_secrets_whole"])
def test_whole_texts_are_redacted(spark, name):
    oracle.check(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name,cut", [("distinct_words", "distinct_capped")])
def test_whole_texts_are_hashed(spark, name, cut):
    oracle.check(spark, QUERIES[name], ORACLES[name], SF)
    column = "clean_sha" if "clean_sha" in QUERIES[name](spark, SF).columns else "words_sha"
    whole, part = ({tuple(r) for r in q(spark, SF).select("doc_id", column).collect()} for q in (QUERIES[name], QUERIES[cut]))
    print("DIFFER", name, len(whole - part), "of", len(whole))
    assert whole - part


def test_stream_keeps_events_months_late(spark, tmp_path):
    days = ["2024-06-01", "2024-05-30", "2024-01-01", "2024-03-01"]
    for day in days:
        spark.sql(f"SELECT TIMESTAMP '{day} 01:00:00' AS ts, 'a' AS event_type, 1.5D AS value").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    rows = spark.read.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = E.settle(E.tumbling(stream, "6 hours", ["event_type"]), ["start_s", "event_type"], "late")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.tumbling(rows, "6 hours", ["event_type"]).collect()))
