import pytest
from pyspark.sql import functions as F

from lectern.operators import gates as G

SNAPSHOT = {"layout": "'v1'", "age_s": "30.0", "host": "'render'", "ram_total": "7.0", "threads": "8", "n_samples": "5", "ram_least": "2.1", "disk_c": "2.0", "disk_d": "10.0", "temp": "'D:'", "workers_known": "true", "n_tts": "0", "n_asr": "0", "n_unknown": "0", "n_workers": "0", "latch": "'ON'", "owner": "'VERIFIED'", "mutex": "'FREE'", "stage": "'TTS'"}
#: What is changed in a snapshot that passes, and the reasons that come of it; literals of the surveyed rules.
ADMISSION = [
    ({}, []),
    ({"layout": "'v2'"}, ["TELEMETRY_SCHEMA_UNVERIFIED"]),
    ({"age_s": "30.1"}, ["TELEMETRY_STALE_OR_UNVERIFIED"]), ({"age_s": "-5.1"}, ["TELEMETRY_STALE_OR_UNVERIFIED"]), ({"age_s": "null"}, ["TELEMETRY_STALE_OR_UNVERIFIED"]), ({"age_s": "-5.0"}, []),
    ({"host": "'x'"}, ["WRONG_HOST"]),
    ({"ram_total": "9.1"}, ["EXPECTED_8GB_MACHINE_NOT_PROVEN"]), ({"ram_total": "6.9"}, ["EXPECTED_8GB_MACHINE_NOT_PROVEN"]),
    ({"threads": "0"}, ["CPU_INVENTORY_UNAVAILABLE"]), ({"threads": "9"}, ["CPU_INVENTORY_UNAVAILABLE"]), ({"threads": "null"}, ["CPU_INVENTORY_UNAVAILABLE"]),
    ({"n_samples": "4", "ram_least": "null"}, ["RAM_SAMPLES_MISSING_OR_INVALID"]), ({"n_samples": "null"}, ["RAM_SAMPLES_MISSING_OR_INVALID"]),
    ({"ram_least": "2.09"}, ["INSUFFICIENT_STABLE_RAM_TTS"]), ({"stage": "'ASR'", "ram_least": "2.49"}, ["INSUFFICIENT_STABLE_RAM_ASR"]), ({"stage": "'ASR'", "ram_least": "2.5"}, []),
    ({"disk_c": "1.9"}, ["LOW_C_DRIVE_HEADROOM"]), ({"disk_c": "null"}, ["LOW_C_DRIVE_HEADROOM"]), ({"disk_d": "9.9"}, ["LOW_D_DRIVE_HEADROOM"]),
    ({"temp": "'E:'"}, ["TEMP_DRIVE_UNKNOWN"]), ({"temp": "null"}, ["TEMP_DRIVE_UNKNOWN"]), ({"temp": "'C:'", "disk_c": "3.9"}, ["TEMP_ON_LOW_SPACE_C_DRIVE"]), ({"temp": "'C:'", "disk_c": "4.0"}, []),
    ({"workers_known": "false"}, ["HEAVY_WORKER_INVENTORY_MISSING"]), ({"workers_known": "null", "n_workers": "null"}, ["HEAVY_WORKER_INVENTORY_MISSING"]),
    ({"n_workers": "1", "n_tts": "1"}, ["HEAVY_WORKER_ALREADY_ACTIVE"]), ({"n_workers": "2", "n_tts": "1", "n_asr": "1"}, ["HEAVY_WORKER_ALREADY_ACTIVE", "CONCURRENT_TTS_ASR_DETECTED"]), ({"n_workers": "1", "n_unknown": "1"}, ["HEAVY_WORKER_ALREADY_ACTIVE", "UNIDENTIFIED_HEAVY_WORKER"]),
    ({"latch": "'OFF'"}, ["OWNER_LATCH_UNVERIFIED_OR_STOPPED"]), ({"owner": "null"}, ["CHECKPOINT_OWNERSHIP_UNVERIFIED"]), ({"mutex": "'HELD'"}, ["WORKER_MUTEX_UNVERIFIED"]),
]
JOB = SNAPSHOT | {"action": "'resume'", "state": "'QUEUED'", "owner_start": "true", "witness": "true", "barrier": "true", "has_snapshot": "true"}
JOBS = [
    ({}, []),
    ({"action": "'export'"}, ["ACTION_NOT_QUALIFIED_FOR_SEQUENTIAL_ADMISSION", "RESOURCE_SNAPSHOT_UNAVAILABLE"]),
    ({"action": "'improve'", "barrier": "false"}, ["ACTION_NOT_QUALIFIED_FOR_SEQUENTIAL_ADMISSION", "LEGACY_COMPOSITE_PHASE_BARRIER_UNVERIFIED", "RESOURCE_SNAPSHOT_UNAVAILABLE"]),
    ({"state": "'DONE'"}, ["JOB_STATE_NOT_QUEUED"]), ({"state": "'WAIT_OTHER_WORKER'"}, []), ({"witness": "false"}, ["OWNER_START_WITNESS_UNVERIFIED"]), ({"owner_start": "null"}, ["OWNER_START_WITNESS_UNVERIFIED"]),
    ({"barrier": "null"}, ["LEGACY_COMPOSITE_PHASE_BARRIER_UNVERIFIED"]), ({"action": "'recheck'", "barrier": "false"}, []),
    ({"has_snapshot": "false", "host": "'x'"}, ["RESOURCE_SNAPSHOT_UNAVAILABLE"]), ({"host": "'x'", "mutex": "null"}, ["WRONG_HOST", "WORKER_MUTEX_UNVERIFIED"]),
]
FRAME = {"gen_a": "'g1'", "gen_b": "'g1'", "t_a": "0", "t_b": "30000", "t_now": "35000", "start": "true", "stop": "false", "checkpoint": "true", "source": "true", "acked": "true", "released": "true", "reaped": "true", "mutex_free": "true", "unloaded": "true", "n_tts": "0", "n_asr": "0", "n_other": "0", "threads": "1", "ram": "1.0", "least": "1.0", "disk_c": "2.0", "disk_d": "10.0"}
HANDOFFS = [
    ({}, []),
    ({"gen_b": "'g2'"}, ["GENERATION_UNVERIFIED_OR_CHANGED"]), ({"gen_a": "''", "gen_b": "''"}, ["GENERATION_UNVERIFIED_OR_CHANGED"]), ({"gen_a": "'é'", "gen_b": "'é'"}, ["GENERATION_UNVERIFIED_OR_CHANGED"]), ({"gen_a": "repeat('x', 81)", "gen_b": "repeat('x', 81)"}, ["GENERATION_UNVERIFIED_OR_CHANGED"]), ({"gen_a": "null"}, ["GENERATION_UNVERIFIED_OR_CHANGED"]),
    ({"t_a": "-1"}, ["INVALID_MONOTONIC_TIMESTAMPS"]), ({"t_now": "null"}, ["INVALID_MONOTONIC_TIMESTAMPS"]),
    ({"t_b": "30001"}, ["TRANSITION_STALE_OR_OUT_OF_ORDER"]), ({"t_now": "35001"}, ["TRANSITION_STALE_OR_OUT_OF_ORDER"]), ({"t_now": "29999"}, ["TRANSITION_STALE_OR_OUT_OF_ORDER"]), ({"t_a": "30001"}, ["TRANSITION_STALE_OR_OUT_OF_ORDER"]),
    ({"start": "false"}, ["OWNER_START_NOT_ATTESTED"]), ({"stop": "null"}, ["OWNER_STOP_ACTIVE_OR_UNKNOWN"]), ({"stop": "true"}, ["OWNER_STOP_ACTIVE_OR_UNKNOWN"]), ({"checkpoint": "null"}, ["CHECKPOINT_OWNERSHIP_UNVERIFIED"]), ({"source": "false"}, ["SOURCE_VOICE_MODEL_UNVERIFIED"]),
    ({"acked": "false"}, ["TTS_SHUTDOWN_NOT_ACKED"]), ({"released": "false"}, ["TTS_OBJECT_STILL_REFERENCED"]), ({"reaped": "null"}, ["TTS_PROCESS_NOT_REAPED"]), ({"mutex_free": "false"}, ["TTS_MUTEX_NOT_RELEASED"]), ({"unloaded": "false"}, ["TTS_MODEL_UNLOAD_NOT_PROVEN"]),
    ({"n_tts": "1"}, ["TTS_WORKER_COUNT_INVALID"]), ({"n_asr": "-1"}, ["ASR_WORKER_COUNT_INVALID"]), ({"n_other": "null"}, ["HEAVY_WORKER_COUNT_INVALID"]), ({"threads": "2"}, ["THREAD_LIMIT_NOT_ONE"]),
    ({"ram": "double('NaN')"}, ["RESOURCE_MEASUREMENT_INVALID"]), ({"disk_c": "-1.0"}, ["RESOURCE_MEASUREMENT_INVALID"]), ({"disk_d": "double('Infinity')"}, ["RESOURCE_MEASUREMENT_INVALID"]), ({"least": "null"}, ["RESOURCE_MEASUREMENT_INVALID"]),
    ({"least": "0.9"}, ["RAM_BELOW_PROPOSED_FLOOR"]), ({"ram": "1.5", "least": "1.6"}, ["RAM_BELOW_PROPOSED_FLOOR"]), ({"disk_c": "1.9"}, ["DISK_BELOW_PROPOSED_FLOOR"]), ({"disk_d": "9.9", "least": "0.5"}, ["RAM_BELOW_PROPOSED_FLOOR", "DISK_BELOW_PROPOSED_FLOOR"]),
]


@pytest.mark.parametrize("needs,good,rows", [(G.ADMISSION, SNAPSHOT, ADMISSION), (G.JOB, JOB, JOBS), (G.HANDOFF, FRAME, HANDOFFS)])
def test_every_condition(spark, needs, good, rows):
    facts = spark.sql(" UNION ALL ".join(f"SELECT {i} AS i, " + ", ".join(f"{e} AS {k}" for k, e in (good | change).items()) for i, (change, _) in enumerate(rows)))
    got = {r.i: r.reasons for r in G.judged(facts, needs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
    assert {r for _, want in rows for r in want} >= set(needs) - set(G.ADMISSION if needs is G.JOB else ())


COLUMNS = "chapter int, index int, gap_ms int, gap_seconds double, structural boolean, edge_start double, edge_end double, rate int, gap_rate int, head double, tail double, canonical_text string, spoken_text string, directed boolean"


def segment(i, **change):
    return {"chapter": 1, "index": i, "gap_ms": 600 + i, "gap_seconds": (600 + i) / 1000, "structural": False, "edge_start": 0.0, "edge_end": 0.0, "rate": 24000, "gap_rate": 24000, "head": 0.01, "tail": 0.01, "canonical_text": f"Một câu {i}.", "spoken_text": f"Một  câu {i}.", "directed": True} | change


#: Changes of segment 1, of its evidence and of the receipt, and the findings beside REPAIR_RECEIPT_NOT_PROVIDED or what the receipt says.
AUDITS = [
    ({}, {}, None, {"QC05_POST_REPAIR": "REPAIR_RECEIPT_NOT_PROVIDED=1"}),
    ({}, {}, {}, {}),
    ({}, {}, {"whole_chapter_approved": False}, {"QC05_POST_REPAIR": "WHOLE_CHAPTER_LISTENING_PENDING=1"}),
    ({"gap_ms": 1400, "gap_seconds": 1.4}, {}, {}, {"QC01_PAUSE": "LONG_PAUSE=1"}),
    ({"gap_ms": 499, "gap_seconds": 0.499, "structural": True}, {}, {}, {"QC01_PAUSE": "STRUCTURAL_PAUSE_SHORT=1"}),
    ({"edge_end": -0.041}, {}, {}, {"QC02_JOIN": "NONZERO_WAV_BOUNDARY=1"}),
    ({"gap_rate": 22050}, {}, {}, {"QC02_JOIN": "RATE_MISMATCH=1"}),
    ({"head": 0.0399}, {}, {}, {"QC02_JOIN": "EDGE_ENERGY_CHANGE=1"}),
    ({"head": 0.0398}, {}, {}, {}),
    ({}, {"status": "REVIEW"}, {}, {"QC04_PRONUNCIATION": "ASR_REVIEW=1"}),
    ({}, {"status": None}, {}, {"QC04_PRONUNCIATION": "ASR_REVIEW=1"}),
    ({}, {"expected": "một câu 1"}, {}, {"QC04_PRONUNCIATION": "QC_EXPECTED_TEXT_DIFFERS=1"}),
    ({}, {"expected": " MỘT CÂU\n1. "}, {}, {}),
    ({"spoken_text": ""}, {}, {}, {}),
    ({"canonical_text": "Một ĐHQG 1."}, {}, {}, {"QC04_PRONUNCIATION": "ABBREVIATION_NEEDS_PRONUNCIATION_CHECK=1"}),
    ({"canonical_text": "ABCDEFG x_AB A AI"}, {}, {}, {"QC04_PRONUNCIATION": "ABBREVIATION_NEEDS_PRONUNCIATION_CHECK=1"}),
    ({"canonical_text": "ABCDEFG x_AB A"}, {}, {}, {}),
    ({"directed": None}, {}, {}, {"QC03_PROSODY": "NO_CONTEXTUAL_PROSODY_EVIDENCE=1"}),
    ({"gap_ms": 600, "gap_seconds": 0.6}, {}, {}, {}),
    ({"index": 3}, {}, {}, "NONCANONICAL_SEGMENT_ORDER"),
    ({"index": 0}, {}, {}, "NONCANONICAL_SEGMENT_ORDER"),
    ({}, {"index": 7}, {}, "WHISPER_QC_INCOMPLETE"),
    ({"gap_seconds": 0.6051}, {}, {}, "GAP_LENGTH_INVALID"),
    ({"gap_seconds": None}, {}, {}, "GAP_LENGTH_INVALID"),
    ({}, {}, {"source_ok": None}, "SOURCE_HASH_MISMATCH"),
    ({}, {}, {"output_ok": False}, "REVIEW_HASH_MISMATCH"),
    ({}, {}, {"changed": [0, 0]}, "REPAIR_INDEX_INVALID"),
    ({}, {}, {"changed": [3]}, "REPAIR_INDEX_INVALID"),
]


def test_audit(spark):
    segments, evidence, receipts = [], [], []
    for c, (own, heard, receipt, _) in enumerate(AUDITS):
        segments += [segment(i, **(own if i == 1 else {}), chapter=c) for i in range(3)]
        evidence += [{"chapter": c, "index": i, "status": "PASS", "expected": f"Một câu {i}."} | (heard if i == 1 else {}) for i in range(3)]
        receipts += [] if receipt is None else [{"chapter": c, "source_ok": True, "output_ok": True, "whole_chapter_approved": True, "changed": [1]} | receipt]
    tables = [spark.createDataFrame(rows, kind) for rows, kind in ((segments, COLUMNS), (evidence, "chapter int, index int, status string, expected string"), (receipts, "chapter int, source_ok boolean, output_ok boolean, whole_chapter_approved boolean, changed array<int>"))]
    got = {}
    for r in G.audit(*tables).collect():
        got.setdefault(r.chapter, {})[r.stage] = (r.status, r.findings, r.reason_counts, r.error)
    for c, (*_, want) in enumerate(AUDITS):
        if isinstance(want, str):
            assert set(got[c].values()) == {("INVALID", 0, "", want)}, AUDITS[c]
        else:
            assert got[c] == {d: ("REVIEW", 1, want[d], None) if d in want else ("MEASURED_NOT_HUMAN_VERIFIED", 0, "", None) for d in G.DIMENSIONS}, AUDITS[c]
    assert G.audit(*(t.limit(0) for t in tables)).count() == 0


def test_dominated_pauses(spark):
    rows = [segment(i, gap_ms=600, gap_seconds=0.6) for i in range(8)] + [segment(i) for i in (8, 9)]
    evidence = spark.createDataFrame([(1, i, "PASS", f"Một câu {i}.") for i in range(10)], "chapter int, index int, status string, expected string")
    none = spark.createDataFrame([], "chapter int, source_ok boolean, output_ok boolean, whole_chapter_approved boolean, changed array<int>")
    out = G.audit(spark.createDataFrame(rows, COLUMNS), evidence, none).where(F.col("stage") == "QC01_PAUSE").first()
    assert out.reason_counts == "PAUSE_DISTRIBUTION_DOMINATED=1"
