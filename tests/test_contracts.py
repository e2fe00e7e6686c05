import pytest
from pyspark.sql import functions as F

from lectern.operators import contracts as C

H = "repeat('a', 64)"
#: For each kind a sound record, and changes with the rules that they break; literals of the surveyed rules.
RECORDS = {
    "text_layers": ({"original_text": "'a'", "normalized_text": "'a'", "spoken_text": "'a'", "source_sha256": H}, [({"original_text": "' '"}, ["original_text"]), ({"normalized_text": "null"}, ["normalized_text"]), ({"spoken_text": "''"}, ["spoken_text"]), ({"source_sha256": "'ab'"}, ["source_sha256"])]),
    "book_profile": ({"genre": "'G'", "confidence": "1.0", "n_recommended": "1", "dialogue_density": "'low'", "technical_density": "'high'"}, [({"genre": "''"}, ["genre"]), ({"confidence": "1.01"}, ["confidence"]), ({"confidence": "-0.01"}, ["confidence"]), ({"n_recommended": "0"}, ["recommended_narration_profiles"]), ({"dialogue_density": "'some'", "technical_density": "null"}, ["dialogue_density", "technical_density"])]),
    "narration_profile": ({"key": "'k'", "expression": "0.0", "stability": "1.0"}, [({"key": "' '"}, ["key"]), ({"expression": "1.1", "stability": "null"}, ["expression", "stability"])]),
    "voice_request": ({"operation_id": "'o'", "sample_id": "'s'", "text": "'t'", "narration_fingerprint": H, "voice_key": "'v'", "output_format": "'OGG'", "output_path": "'p'"}, [({"operation_id": "''"}, ["ids_and_text"]), ({"text": "' '"}, ["ids_and_text"]), ({"narration_fingerprint": "'x'"}, ["narration_fingerprint"]), ({"voice_key": "' '"}, ["voice_key"]), ({"output_format": "'AAC'"}, ["output_format"]), ({"output_path": "null"}, ["output_path"])]),
    "voice_result": ({"operation_id": "'o'", "sample_id": "'s'", "provider": "'p'", "status": "'SUCCESS'", "byte_count": "1", "attempt": "1", "audio_sha256": H, "local_audio_path": "'l'"}, [({"provider": "''"}, ["ids_and_provider"]), ({"status": "'DONE'"}, ["status"]), ({"byte_count": "-1", "status": "'FAILED'"}, ["byte_count"]), ({"attempt": "0"}, ["attempt"]), ({"audio_sha256": "'x'"}, ["audio_sha256"]), ({"audio_sha256": "null"}, ["success_is_whole"]), ({"byte_count": "0"}, ["success_is_whole"]), ({"local_audio_path": "null"}, ["success_is_whole"]), ({"status": "'FAILED'", "audio_sha256": "null", "byte_count": "0"}, [])]),
    "observation": (
        {"chunk_id": "'c'", "audio_sha256": H, "attempt": "1", "asr_similarity": "null", "min_word_confidence": "0.0", "mean_word_confidence": "1.0", "pause_ratio": "0.5", "clipping_ratio": "null", "speaking_rate_wpm": "null", "pitch_variation_semitones": "0.0"},
        [({"chunk_id": "' '"}, ["chunk_id"]), ({"audio_sha256": "null"}, ["audio_sha256"]), ({"attempt": "0"}, ["attempt"]), ({"asr_similarity": "1.01"}, ["asr_similarity"]), ({"min_word_confidence": "-0.1"}, ["min_word_confidence"]), ({"mean_word_confidence": "2.0"}, ["mean_word_confidence"]), ({"pause_ratio": "-1.0"}, ["pause_ratio"]), ({"clipping_ratio": "1.1"}, ["clipping_ratio"]), ({"speaking_rate_wpm": "0.0"}, ["speaking_rate_wpm"]), ({"pitch_variation_semitones": "-0.1"}, ["pitch_variation_semitones"])],
    ),
    "quality_policy": (
        {"asr_pass_similarity": "0.9", "asr_hard_fail_similarity": "0.6", "min_word_confidence": "0.68", "hard_fail_word_confidence": "0.4", "min_pause_ratio": "0.05", "max_pause_ratio": "0.34", "max_clipping_ratio": "0.005", "min_speaking_rate_wpm": "95.0", "max_speaking_rate_wpm": "185.0", "min_pitch_variation_semitones": "0.65", "max_auto_attempts": "2"},
        [({"asr_pass_similarity": "1.1"}, ["asr_pass_similarity"]), ({"asr_hard_fail_similarity": "-0.1"}, ["asr_hard_fail_similarity"]), ({"min_word_confidence": "1.2"}, ["min_word_confidence"]), ({"hard_fail_word_confidence": "-1.0"}, ["hard_fail_word_confidence"]), ({"min_pause_ratio": "-0.1"}, ["min_pause_ratio"]), ({"max_pause_ratio": "1.1"}, ["max_pause_ratio"]), ({"max_clipping_ratio": "2.0"}, ["max_clipping_ratio"]), ({"asr_hard_fail_similarity": "0.9"}, ["hard_fail_below_pass"]), ({"hard_fail_word_confidence": "0.68"}, ["hard_fail_below_review"]), ({"min_speaking_rate_wpm": "0.0"}, ["speaking_rate_range"]), ({"max_speaking_rate_wpm": "95.0"}, ["speaking_rate_range"]), ({"max_pause_ratio": "0.05"}, ["pause_range"]), ({"min_pitch_variation_semitones": "-0.1"}, ["pitch_threshold"]), ({"max_auto_attempts": "0"}, ["attempts"])],
    ),
}


def rows_of(spark, good, changes):
    return spark.sql(" UNION ALL ".join(f"SELECT {i} AS i, " + ", ".join(f"{e} AS {k}" for k, e in (good | c).items()) for i, c in enumerate(changes)))


@pytest.mark.parametrize("kind", sorted(RECORDS))
def test_every_rule(spark, kind):
    good, broken = RECORDS[kind]
    rows = rows_of(spark, good, [{}, *(c for c, _ in broken)])
    contract = C.RECORDS[kind]
    got = {r.i: r.v for r in rows.select("i", C.violated(contract).alias("v")).collect()}
    assert got == {0: [], **{i + 1: want for i, (_, want) in enumerate(broken)}}
    assert {r for _, want in broken for r in want} == set(contract)
    # observed beside another action, and strict
    seen_rows, seen = C.observed(rows, contract, kind)
    assert seen_rows.count() == len(broken) + 1
    assert seen.get == {"rows": len(broken) + 1} | {rule: sum(rule in want for _, want in broken) for rule in contract}
    assert C.strict(rows.where("i = 0"), contract).count() == 1
    with pytest.raises(Exception, match="broken: "):
        C.strict(rows, contract).collect()


REQUEST = {"authenticated": "true", "n_unknown_fields": "0", "n_missing_fields": "0", "schema": "'v1'", "task": "'T1'", "target": "'library'", "action": "'inventory_readonly'", "root_key": "'MAIN'", "scope": "'audio'", "mode": "'hash'", "hash_offset": "5000", "metadata_sha": "repeat('F', 64)", "main_sha": "repeat('0', 40)", "sot_verified": "true"}
REFUSED = [
    ({}, None), ({"authenticated": "null", "n_unknown_fields": "1"}, "MCP_TRANSPORT_NOT_AUTHENTICATED"), ({"n_unknown_fields": "1"}, "REQUEST_SCHEMA_NOT_ALLOWLISTED"), ({"n_missing_fields": "1"}, "REQUEST_SCHEMA_NOT_ALLOWLISTED"), ({"action": "'write'"}, "REQUEST_ACTION_NOT_ALLOWLISTED"), ({"task": "null"}, "REQUEST_ACTION_NOT_ALLOWLISTED"),
    ({"root_key": "'../x'"}, "ROOT_KEY_INVALID"), ({"scope": "'disk'"}, "READ_SCOPE_OR_MODE_INVALID"), ({"mode": "'all'"}, "READ_SCOPE_OR_MODE_INVALID"), ({"hash_offset": "5001"}, "HASH_OFFSET_INVALID"), ({"hash_offset": "-1"}, "HASH_OFFSET_INVALID"), ({"mode": "'metadata'", "hash_offset": "1"}, "METADATA_OFFSET_INVALID"), ({"mode": "'metadata'", "hash_offset": "0"}, None),
    ({"metadata_sha": "'xyz'"}, "METADATA_SHA_INVALID"), ({"metadata_sha": "null"}, "PAGED_HASH_REQUIRES_FINGERPRINT"), ({"metadata_sha": "null", "hash_offset": "0"}, None), ({"main_sha": "repeat('A', 40)"}, "MAIN_REVISION_INVALID"), ({"sot_verified": "null"}, "SOT_MAIN_AUTHORITY_UNVERIFIED"),
]


def test_requests(spark):
    got = {r.i: r.w for r in rows_of(spark, REQUEST, [c for c, _ in REFUSED]).select("i", C.refused(C.READ_REQUEST).alias("w")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(REFUSED)}
    assert {w for _, w in REFUSED if w} == set(C.READ_REQUEST)


def test_drift(spark):
    kind = "k int, a string, b double"
    before = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "x", None), (4, "x", 4.0), (5, None, None)], kind)
    after = spark.createDataFrame([(1, "x", 1.0), (2, "y", 3.0), (3, "x", 0.0), (6, "x", 6.0), (5, None, None)], kind)
    got = {r.k: (r.status, r.drifted) for r in C.drift(before, after, ["k"], ["a", "b"]).collect()}
    assert got == {1: ("SAME", []), 2: ("CHANGED", ["a", "b"]), 3: ("CHANGED", ["b"]), 4: ("MISSING_AFTER", []), 5: ("SAME", []), 6: ("MISSING_BEFORE", [])}
    assert C.drift(before.limit(0), after.limit(0), ["k"], ["a"]).count() == 0


CHUNK = {"technical_error": None, "audio_sha256": "a" * 64, "profile": "P", "speaking_rate_wpm": 1.0, "pause_ratio": 0.1, "pitch_variation_semitones": 1.0, "energy_variation_db": 1.0, "n_unclear": 0, "min_word_confidence": 0.68, "n_prosody": 0, "warnings": 0, "errors": 0}
CASES = [
    ({}, {}, (0, 0, None, "PASS")), ({"expected_chunks": 3}, {}, (0, 0, "CHUNK_COUNT_MISMATCH", "REFUSED")), ({"profile": "Q"}, {}, (0, 0, "PROFILE_MISMATCH", "REFUSED")), ({"fingerprint": None}, {}, (0, 0, "PROFILE_FINGERPRINT_MISSING", "REFUSED")),
    ({}, {"technical_error": "clipped"}, (0, 0, "TECHNICAL_ERROR", "REFUSED")), ({}, {"audio_sha256": "zz"}, (0, 0, "AUDIO_HASH_INVALID", "REFUSED")), ({}, {"audio_sha256": None}, (0, 0, "AUDIO_HASH_INVALID", "REFUSED")), ({}, {"profile": None}, (0, 0, "CHUNK_PROFILE_MISSING", "REFUSED")),
    ({}, {"speaking_rate_wpm": None}, (0, 0, "PROSODY_METRICS_INCOMPLETE", "REFUSED")), ({}, {"energy_variation_db": None}, (0, 0, "PROSODY_METRICS_INCOMPLETE", "REFUSED")),
    ({}, {"n_unclear": 2}, (1, 0, None, "PASS")), ({}, {"min_word_confidence": 0.67}, (1, 0, None, "PASS")), ({}, {"min_word_confidence": None}, (0, 0, None, "PASS")), ({}, {"n_prosody": 1}, (0, 1, None, "PASS")), ({}, {"warnings": 1}, (0, 0, None, "REVIEW")), ({}, {"errors": 2}, (0, 0, None, "REVIEW")),
]


def test_cases(spark):
    expected = [{"id": i, "expected_chunks": 2, "expected_profile": "P", "profile": "P", "fingerprint": "f"} | e for i, (e, _, _) in enumerate(CASES)] + [{"id": 99, "expected_chunks": 0, "expected_profile": "P", "profile": "P", "fingerprint": "f"}]
    chunks = [{"id": i} | CHUNK | (c if k else {}) for i, (_, c, _) in enumerate(CASES) for k in range(2)]
    e = spark.createDataFrame(expected, "id int, expected_chunks int, expected_profile string, profile string, fingerprint string")
    c = spark.createDataFrame(chunks, "id int, technical_error string, audio_sha256 string, profile string, speaking_rate_wpm double, pause_ratio double, pitch_variation_semitones double, energy_variation_db double, n_unclear int, min_word_confidence double, n_prosody int, warnings int, errors int")
    got = {r.id: (r.pronunciation_defects, r.prosody_defects, r.refused, r.verdict) for r in C.cases(e, c, "id").collect()}
    assert got == {i: w for i, (*_, w) in enumerate(CASES)} | {99: (0, 0, None, "PASS")}
    assert {w[2] for *_, w in CASES if w[2]} == set(C.CASE)
    assert C.cases(e, c, "id").where("id = 1").select(F.col("n_chunks")).first()[0] == 2
