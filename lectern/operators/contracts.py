"""Records held against contracts that are data: a rule's name and the condition that a sound record meets, which both engines read (MATCHES is
a regular expression's search). From one table of rules come a report of what each record breaks, counts that are observed while something
else runs, a strict mode that fails, and the first reason to refuse a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .rules import first_failing, reasons

_SHARE = "coalesce({0}, 0.0) BETWEEN 0.0 AND 1.0"
_HEX64 = "MATCHES({0}, '^[0-9a-fA-F]{{64}}$')"
_SAID = "trim({0}) <> ''"
# The ranges, lengths and choices of each kind of record.
TEXT_LAYERS = {"original_text": _SAID.format("original_text"), "normalized_text": _SAID.format("normalized_text"), "spoken_text": _SAID.format("spoken_text"), "source_sha256": "length(source_sha256) = 64"}
BOOK_PROFILE = {"genre": "genre <> ''", "confidence": "confidence BETWEEN 0.0 AND 1.0", "recommended_narration_profiles": "n_recommended > 0", "dialogue_density": "dialogue_density IN ('low', 'medium', 'high')", "technical_density": "technical_density IN ('low', 'medium', 'high')"}
NARRATION_PROFILE = {"key": _SAID.format("key"), "expression": "expression BETWEEN 0.0 AND 1.0", "stability": "stability BETWEEN 0.0 AND 1.0"}
VOICE_REQUEST = {"ids_and_text": "operation_id <> '' AND sample_id <> '' AND trim(text) <> ''", "narration_fingerprint": "length(narration_fingerprint) = 64", "voice_key": _SAID.format("voice_key"), "output_format": "output_format IN ('WAV', 'MP3', 'FLAC', 'OGG')", "output_path": _SAID.format("output_path")}
VOICE_RESULT = {
    "ids_and_provider": "operation_id <> '' AND sample_id <> '' AND provider <> ''",
    "status": "status IN ('SUCCESS', 'FAILED', 'ACTION_REQUIRED')",
    "byte_count": "byte_count >= 0",
    "attempt": "attempt >= 1",
    "audio_sha256": "audio_sha256 IS NULL OR length(audio_sha256) = 64",
    "success_is_whole": "status <> 'SUCCESS' OR (local_audio_path <> '' AND audio_sha256 <> '' AND byte_count > 0)",
}
OBSERVATION = {
    "chunk_id": _SAID.format("chunk_id"),
    "audio_sha256": "length(audio_sha256) = 64",
    "attempt": "attempt >= 1",
    **{name: _SHARE.format(name) for name in ("asr_similarity", "min_word_confidence", "mean_word_confidence", "pause_ratio", "clipping_ratio")},
    "speaking_rate_wpm": "coalesce(speaking_rate_wpm, 1.0) > 0",
    "pitch_variation_semitones": "coalesce(pitch_variation_semitones, 0.0) >= 0",
}
QUALITY_POLICY = {
    **{name: f"{name} BETWEEN 0.0 AND 1.0" for name in ("asr_pass_similarity", "asr_hard_fail_similarity", "min_word_confidence", "hard_fail_word_confidence", "min_pause_ratio", "max_pause_ratio", "max_clipping_ratio")},
    "hard_fail_below_pass": "asr_hard_fail_similarity < asr_pass_similarity",
    "hard_fail_below_review": "hard_fail_word_confidence < min_word_confidence",
    "speaking_rate_range": "min_speaking_rate_wpm > 0 AND max_speaking_rate_wpm > min_speaking_rate_wpm",
    "pause_range": "max_pause_ratio > min_pause_ratio",
    "pitch_threshold": "min_pitch_variation_semitones >= 0",
    "attempts": "max_auto_attempts >= 1",
}
#: What each kind of record is called.
RECORDS = {"text_layers": TEXT_LAYERS, "book_profile": BOOK_PROFILE, "narration_profile": NARRATION_PROFILE, "voice_request": VOICE_REQUEST, "voice_result": VOICE_RESULT, "observation": OBSERVATION, "quality_policy": QUALITY_POLICY}

# Why a read request is refused, the first reason alone. Facts: authenticated, n_unknown_fields, n_missing_fields, schema, task, target, action,
# root_key, scope, mode, hash_offset, metadata_sha, main_sha, sot_verified.
READ_REQUEST = {
    "MCP_TRANSPORT_NOT_AUTHENTICATED": "authenticated",
    "REQUEST_SCHEMA_NOT_ALLOWLISTED": "n_unknown_fields = 0 AND n_missing_fields = 0",
    "REQUEST_ACTION_NOT_ALLOWLISTED": "schema = 'v1' AND task = 'T1' AND target = 'library' AND action = 'inventory_readonly'",
    "ROOT_KEY_INVALID": "MATCHES(root_key, '^[A-Z][A-Z0-9_]{2,31}$')",
    "READ_SCOPE_OR_MODE_INVALID": "scope IN ('audio', 'narrator', 'checkpoint', 'model') AND mode IN ('metadata', 'hash')",
    "HASH_OFFSET_INVALID": "hash_offset BETWEEN 0 AND 5000",
    "METADATA_OFFSET_INVALID": "mode <> 'metadata' OR hash_offset = 0",
    "METADATA_SHA_INVALID": "metadata_sha IS NULL OR " + _HEX64.format("metadata_sha"),
    "PAGED_HASH_REQUIRES_FINGERPRINT": "hash_offset = 0 OR metadata_sha IS NOT NULL",
    "MAIN_REVISION_INVALID": "MATCHES(main_sha, '^[0-9a-f]{40}$')",
    "SOT_MAIN_AUTHORITY_UNVERIFIED": "sot_verified",
}
# Why a case of chunks is refused, the first reason alone. Facts are those of `cases` below.
CASE = {
    "CHUNK_COUNT_MISMATCH": "n_chunks = expected_chunks",
    "PROFILE_MISMATCH": "profile = expected_profile",
    "PROFILE_FINGERPRINT_MISSING": "fingerprint <> ''",
    "TECHNICAL_ERROR": "n_technical = 0",
    "AUDIO_HASH_INVALID": "n_bad_hash = 0",
    "CHUNK_PROFILE_MISSING": "n_other_profile = 0",
    "PROSODY_METRICS_INCOMPLETE": "n_incomplete = 0",
}
#: Words said less surely than this are localized defects.
UNCLEAR_BELOW = 0.68


def _unmet(need: str) -> Column:
    return ~F.coalesce(F.expr(need.replace("MATCHES(", "regexp_like(")), F.lit(False))


def _sql(need: str) -> str:
    return f"NOT coalesce({need.replace('MATCHES(', 'regexp_matches(')}, false)"


def violated(contract: dict[str, str]) -> Column:
    """Names of the rules that a record breaks, in order. What a rule can't tell it counts as broken."""
    return reasons({name: _unmet(need) for name, need in contract.items()})


def violated_sql(contract: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_sql(need)} THEN '{name}' END" for name, need in contract.items()) + ")"


def refused(contract: dict[str, str]) -> Column:
    """The first rule that a record breaks; null if it breaks none."""
    return first_failing({name: _unmet(need) for name, need in contract.items()})


def refused_sql(contract: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {_sql(need)} THEN '{name}'" for name, need in contract.items()) + " END"


def observed(df: DataFrame, contract: dict[str, str], name: str = "contract") -> tuple[DataFrame, Observation]:
    """`df` unchanged, and counts (rows, and how many break each rule) that are there once it has been used: no pass of their own."""
    seen = Observation(name)
    counts = [F.sum(F.when(_unmet(need), 1).otherwise(0)).alias(rule) for rule, need in contract.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def strict(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """`df` unchanged; the first record that breaks a rule fails the query and is told."""
    why = violated(contract)
    return df.where(F.when(F.size(why) > 0, F.raise_error(F.concat(F.lit("broken: "), F.array_join(why, ","), F.lit(" in "), F.to_json(F.struct(*df.columns))))).otherwise(True))


def drift(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, status, drifted: two snapshots compared by every one of `fields`; null equals null. status is SAME, CHANGED (then drifted has
    the fields), MISSING_BEFORE or MISSING_AFTER. Keys are unique and not null."""
    a = before.select(*keys, F.struct(*fields).alias("_a"))
    b = after.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields)))
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    status = F.when(F.col("_a").isNull(), "MISSING_BEFORE").when(F.col("_b").isNull(), "MISSING_AFTER").when(F.size(changed) > 0, "CHANGED").otherwise("SAME")
    return both.select(*keys, status.alias("status"), F.when(whole, changed).otherwise(F.array().cast("array<string>")).alias("drifted"))


def cases(expected: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, pronunciation_defects, prosody_defects, warnings, errors, refused, verdict) of every expected case. expected: key,
    expected_chunks, expected_profile, profile, fingerprint. chunks: key, technical_error, audio_sha256, profile, speaking_rate_wpm, pause_ratio,
    pitch_variation_semitones, energy_variation_db, n_unclear, min_word_confidence, n_prosody, warnings, errors. A case that breaks a rule is REFUSED
    with the first one; else it is REVIEW if there are warnings or errors, else PASS. A case without chunks has 0."""
    c = chunks.withColumnRenamed("profile", "_chunk_profile").join(expected.select(F.col(key).alias("_key"), F.col("expected_profile").alias("_wanted")), F.col(key) == F.col("_key"))
    n = lambda when, name: F.count_if(F.coalesce(when, F.lit(True))).alias(name)
    missing = F.lit(False)
    for metric in ("speaking_rate_wpm", "pause_ratio", "pitch_variation_semitones", "energy_variation_db"):
        missing = missing | F.col(metric).isNull()
    unclear = (F.coalesce("n_unclear", F.lit(0)) > 0) | F.coalesce(F.col("min_word_confidence") < UNCLEAR_BELOW, F.lit(False))
    facts = c.groupBy(F.col(key).alias("_of")).agg(
        F.count("*").alias("n_chunks"), n(F.coalesce("technical_error", F.lit("")) != "", "n_technical"), n(~F.col("audio_sha256").rlike("^[0-9a-fA-F]{64}$"), "n_bad_hash"),
        n(F.col("_chunk_profile") != F.col("_wanted"), "n_other_profile"), n(missing, "n_incomplete"), n(unclear, "pronunciation_defects"), n(F.coalesce("n_prosody", F.lit(0)) > 0, "prosody_defects"),
        F.sum("warnings").alias("warnings"), F.sum("errors").alias("errors"),
    )
    counts = ["n_chunks", "n_technical", "n_bad_hash", "n_other_profile", "n_incomplete", "pronunciation_defects", "prosody_defects", "warnings", "errors"]
    own = expected.join(facts, F.col(key) == F.col("_of"), "left").fillna(0, counts).withColumn("refused", refused(CASE))
    verdict = F.when(F.col("refused").isNotNull(), "REFUSED").when(F.col("warnings") + F.col("errors") > 0, "REVIEW").otherwise("PASS")
    return own.select(key, "n_chunks", "pronunciation_defects", "prosody_defects", "warnings", "errors", "refused", verdict.alias("verdict"))
