"""Gates: tables of facts judged by rules that are data. A rule is a reason and the condition that keeps it away, as an expression over
the facts' columns; a condition that can't be told (null) doesn't. The reasons' names and all bounds are fixed values, as other
systems read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .rules import reasons

# Facts of a host's snapshot and what each must be. 7 to 9 GiB of memory, 1 to 8 threads, 5 samples, of which the least is 2.1 GiB free to
# render and 2.5 to listen, 2 and 10 GiB of disk, 4 GiB where the temporary folder is on the system drive, an age of -5 to 30 s.
# Facts: layout, age_s, host, ram_total, threads, n_samples (0 if one is invalid), ram_least, disk_c, disk_d, temp, workers_known, n_tts, n_asr, n_unknown,
# n_workers, latch, owner, mutex, stage.
ADMISSION = {
    "TELEMETRY_SCHEMA_UNVERIFIED": "layout = 'v1'",
    "TELEMETRY_STALE_OR_UNVERIFIED": "age_s BETWEEN -5 AND 30",
    "WRONG_HOST": "host = 'render'",
    "EXPECTED_8GB_MACHINE_NOT_PROVEN": "ram_total BETWEEN 7.0 AND 9.0",
    "CPU_INVENTORY_UNAVAILABLE": "threads BETWEEN 1 AND 8",
    "RAM_SAMPLES_MISSING_OR_INVALID": "n_samples >= 5",
    "INSUFFICIENT_STABLE_RAM_TTS": "coalesce(n_samples, 0) < 5 OR stage <> 'TTS' OR ram_least >= 2.1",
    "INSUFFICIENT_STABLE_RAM_ASR": "coalesce(n_samples, 0) < 5 OR stage <> 'ASR' OR ram_least >= 2.5",
    "LOW_C_DRIVE_HEADROOM": "disk_c >= 2.0",
    "LOW_D_DRIVE_HEADROOM": "disk_d >= 10.0",
    "TEMP_DRIVE_UNKNOWN": "temp IN ('C:', 'D:')",
    "TEMP_ON_LOW_SPACE_C_DRIVE": "coalesce(temp, '') <> 'C:' OR disk_c IS NULL OR disk_c >= 4.0",
    "HEAVY_WORKER_INVENTORY_MISSING": "workers_known",
    "HEAVY_WORKER_ALREADY_ACTIVE": "NOT coalesce(workers_known, false) OR n_workers = 0",
    "CONCURRENT_TTS_ASR_DETECTED": "NOT coalesce(workers_known, false) OR n_tts = 0 OR n_asr = 0",
    "UNIDENTIFIED_HEAVY_WORKER": "NOT coalesce(workers_known, false) OR n_unknown = 0",
    "OWNER_LATCH_UNVERIFIED_OR_STOPPED": "latch = 'ON'",
    "CHECKPOINT_OWNERSHIP_UNVERIFIED": "owner = 'VERIFIED'",
    "WORKER_MUTEX_UNVERIFIED": "mutex = 'FREE'",
}
_QUALIFIED = "action IN ('recheck', 'resume')"
_HAS = f"({_QUALIFIED} AND coalesce(has_snapshot, false))"
# A queued job's own conditions, before those of its snapshot. Facts: action, state, owner_start, witness, barrier, has_snapshot.
JOB = {
    "ACTION_NOT_QUALIFIED_FOR_SEQUENTIAL_ADMISSION": _QUALIFIED,
    "JOB_STATE_NOT_QUEUED": "state IN ('QUEUED', 'QUEUED_RESOURCE', 'WAIT_OTHER_WORKER')",
    "OWNER_START_WITNESS_UNVERIFIED": "owner_start AND witness",
    "LEGACY_COMPOSITE_PHASE_BARRIER_UNVERIFIED": "coalesce(action, '') NOT IN ('resume', 'improve') OR barrier",
    "RESOURCE_SNAPSHOT_UNAVAILABLE": _HAS,
} | {name: f"NOT {_HAS} OR coalesce({need}, false)" for name, need in ADMISSION.items()}
_TIMES = "coalesce(t_a >= 0 AND t_b >= 0 AND t_now >= 0, false)"
_MEASURED = "coalesce(ram >= 0 AND ram < 1e300 AND least >= 0 AND least < 1e300 AND disk_c >= 0 AND disk_c < 1e300 AND disk_d >= 0 AND disk_d < 1e300, false)"
# What lets one stage hand over to the next. 5,000 ms of age, 30,000 ms between the two observations, one thread, a floor of 1 GiB, 2 and 10 GiB of
# disk. BYTES is the length in UTF-8. Facts: gen_a, gen_b, t_a, t_b, t_now, start, stop, checkpoint, source, acked, released, reaped, mutex_free, unloaded,
# n_tts, n_asr, n_other, threads, ram, least, disk_c, disk_d.
HANDOFF = {
    "GENERATION_UNVERIFIED_OR_CHANGED": "gen_a = gen_b AND length(gen_a) BETWEEN 1 AND 80 AND BYTES(gen_a) = length(gen_a)",
    "INVALID_MONOTONIC_TIMESTAMPS": _TIMES,
    "TRANSITION_STALE_OR_OUT_OF_ORDER": f"NOT {_TIMES} OR (t_a <= t_b AND t_b <= t_now AND t_now - t_b <= 5000 AND t_b - t_a <= 30000)",
    "OWNER_START_NOT_ATTESTED": "start",
    "OWNER_STOP_ACTIVE_OR_UNKNOWN": "NOT stop",
    "CHECKPOINT_OWNERSHIP_UNVERIFIED": "checkpoint",
    "SOURCE_VOICE_MODEL_UNVERIFIED": "source",
    "TTS_SHUTDOWN_NOT_ACKED": "acked",
    "TTS_OBJECT_STILL_REFERENCED": "released",
    "TTS_PROCESS_NOT_REAPED": "reaped",
    "TTS_MUTEX_NOT_RELEASED": "mutex_free",
    "TTS_MODEL_UNLOAD_NOT_PROVEN": "unloaded",
    "TTS_WORKER_COUNT_INVALID": "n_tts = 0",
    "ASR_WORKER_COUNT_INVALID": "n_asr = 0",
    "HEAVY_WORKER_COUNT_INVALID": "n_other = 0",
    "THREAD_LIMIT_NOT_ONE": "threads = 1",
    "RESOURCE_MEASUREMENT_INVALID": _MEASURED,
    "RAM_BELOW_PROPOSED_FLOOR": f"NOT {_MEASURED} OR (least >= 1.0 AND ram >= least)",
    "DISK_BELOW_PROPOSED_FLOOR": f"NOT {_MEASURED} OR (disk_c >= 2.0 AND disk_d >= 10.0)",
}


def judged(facts: DataFrame, needs: dict[str, str]) -> DataFrame:
    """`facts` with reasons: the names of the rules whose condition doesn't hold, in order."""
    return facts.withColumn("reasons", reasons({name: ~F.coalesce(F.expr(need.replace("BYTES(", "octet_length(")), F.lit(False)) for name, need in needs.items()}))


def reasons_sql(needs: dict[str, str]) -> str:
    """The same for SQL, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({need.replace('BYTES(', 'strlen(')}, false) THEN '{name}' END" for name, need in needs.items()) + ")"


DIMENSIONS = ["QC01_PAUSE", "QC02_JOIN", "QC03_PROSODY", "QC04_PRONUNCIATION", "QC05_POST_REPAIR"]
# Findings of a segment and their conditions: 1,400 and 500 ms, a level of 0.04 at an edge, 12 dB above 0.008; the share of
# the commonest pause; the difference in ms of a gap and its name; capital letters that may be an abbreviation.
FINDINGS = {
    "QC01_PAUSE:LONG_PAUSE": "gap_ms >= 1400",
    "QC01_PAUSE:STRUCTURAL_PAUSE_SHORT": "structural AND gap_ms < 500",
    "QC02_JOIN:NONZERO_WAV_BOUNDARY": "abs(edge_start) > 0.04 OR abs(edge_end) > 0.04",
    "QC02_JOIN:RATE_MISMATCH": "rate <> gap_rate",
    "QC02_JOIN:EDGE_ENERGY_CHANGE": "tail_before > 0.008 AND head > 0.008 AND abs(20 * log10(head / tail_before)) > 12",
    "QC04_PRONUNCIATION:ASR_REVIEW": "coalesce(status, '') <> 'PASS'",
    "QC04_PRONUNCIATION:QC_EXPECTED_TEXT_DIFFERS": "said <> meant",
    "QC04_PRONUNCIATION:ABBREVIATION_NEEDS_PRONUNCIATION_CHECK": "abbreviated",
    "QC03_PROSODY:NO_CONTEXTUAL_PROSODY_EVIDENCE": "NOT coalesce(directed, false)",
}
DOMINANT_SHARE, GAP_TOLERANCE_MS = 0.70, 4
ABBREVIATION = r"(?<![\p{L}\p{N}_])[A-ZĐ]{2,6}(?![\p{L}\p{N}_])"


def _same(text: Column) -> Column:
    """Texts are compared case-folded, with single blanks."""
    return F.trim(F.regexp_replace(X.casefold(F.coalesce(text, F.lit(""))), r"\s+", " "))


def audit(segments: DataFrame, evidence: DataFrame, receipts: DataFrame, chapter: str = "chapter") -> DataFrame:
    """Five dimensions of every chapter: (chapter, stage, status, findings, reason_counts, error). REVIEW where there is a finding, else
    MEASURED_NOT_HUMAN_VERIFIED; a chapter whose tables don't fit each other is INVALID in all, with what is wrong first, and nothing of it is
    measured.

    segments: chapter, index (from 0, without gaps), gap_ms, gap_seconds, structural, edge_start, edge_end, rate, gap_rate, head, tail, canonical_text,
    spoken_text, directed. evidence: chapter, index, status, expected; one row for each segment. receipts: chapter, source_ok, output_ok,
    whole_chapter_approved, changed (indices); at most one for a chapter. A dimension without a finding is a row too. A chapter without a
    receipt is REVIEW after repair: nothing shows that it was heard."""
    s = segments.withColumn("chapter", F.col(chapter))
    e = evidence.select(F.col(chapter).alias("_c"), F.col("index").alias("_i"), "status", "expected")
    r = receipts.select(F.col(chapter).alias("_c"), "source_ok", "output_ok", "whole_chapter_approved", "changed")
    # whether the tables fit
    n = s.groupBy("chapter").agg(F.count("*").alias("n"), F.countDistinct("index").alias("d"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.max(F.coalesce(F.abs(F.col("gap_seconds") * 1000 - F.col("gap_ms")) > GAP_TOLERANCE_MS, F.lit(True))).alias("gap_bad"))
    own = e.groupBy("_c").agg(F.count("*").alias("en"), F.countDistinct("_i").alias("ed"), F.min("_i").alias("elo"), F.max("_i").alias("ehi"))
    checked = n.join(own, F.col("chapter") == F.col("_c"), "left").drop("_c").join(r, F.col("chapter") == F.col("_c"), "left").withColumn("has_receipt", F.col("_c").isNotNull()).drop("_c")
    bad_index = F.coalesce((F.size(F.array_distinct("changed")) != F.size("changed")) | F.exists("changed", lambda i: (i < 0) | (i >= F.col("n"))), F.lit(False))
    fits = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(fits((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))), "NONCANONICAL_SEGMENT_ORDER")
        .when(fits((F.col("en") == F.col("n")) & (F.col("ed") == F.col("n")) & (F.col("elo") == 0) & (F.col("ehi") == F.col("n") - 1)), "WHISPER_QC_INCOMPLETE")
        .when(F.col("gap_bad"), "GAP_LENGTH_INVALID")
        .when(F.col("has_receipt") & fits(F.col("source_ok")), "SOURCE_HASH_MISMATCH")
        .when(F.col("has_receipt") & fits(F.col("output_ok")), "REVIEW_HASH_MISMATCH")
        .when(F.col("has_receipt") & bad_index, "REPAIR_INDEX_INVALID")
    )
    checked = checked.select("chapter", "has_receipt", F.coalesce("whole_chapter_approved", F.lit(False)).alias("approved"), error.alias("error"))
    sound = checked.where("error is null").select(F.col("chapter").alias("_k"), "has_receipt", "approved")
    # findings of the segments, of the pauses, and of the receipt
    s = s.join(sound.select("_k"), F.col("chapter") == F.col("_k"), "left_semi")
    j = s.join(e, (F.col("chapter") == F.col("_c")) & (F.col("index") == F.col("_i")), "left")
    spoken = F.coalesce(F.nullif("spoken_text", F.lit("")), "canonical_text")
    j = j.withColumns({"said": _same(F.col("expected")), "meant": _same(spoken), "abbreviated": F.coalesce(F.col("canonical_text").rlike(ABBREVIATION), F.lit(False)), "tail_before": F.lag("tail").over(W.partitionBy("chapter").orderBy("index"))})
    found = j.select("chapter", F.explode(reasons({name: F.expr(need) for name, need in FINDINGS.items()})).alias("x"))
    share = s.groupBy("chapter", "gap_ms").agg(F.count("*").alias("n")).groupBy("chapter").agg((F.max("n") / F.sum("n")).alias("share"))
    found = found.unionByName(share.where(F.col("share") > DOMINANT_SHARE).select("chapter", F.lit("QC01_PAUSE:PAUSE_DISTRIBUTION_DOMINATED").alias("x")))
    heard = F.when(~F.col("has_receipt"), "QC05_POST_REPAIR:REPAIR_RECEIPT_NOT_PROVIDED").when(~F.col("approved"), "QC05_POST_REPAIR:WHOLE_CHAPTER_LISTENING_PENDING")
    found = found.unionByName(sound.select(F.col("_k").alias("chapter"), heard.alias("x")).where("x is not null"))
    part = lambda k: F.split_part("x", F.lit(":"), F.lit(k))
    counts = found.groupBy("chapter", part(1).alias("stage"), part(2).alias("code")).agg(F.count("*").alias("n"))
    per = counts.groupBy("chapter", "stage").agg(F.sum("n").alias("findings"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "code", "n"))), ",").alias("reason_counts"))
    every = checked.select("chapter", "error", F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("stage"))
    out = every.join(per, ["chapter", "stage"], "left")
    status = F.when(F.col("error").isNotNull(), "INVALID").when(F.col("findings") > 0, "REVIEW").otherwise("MEASURED_NOT_HUMAN_VERIFIED")
    return out.select(F.col("chapter").alias(chapter), "stage", status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("reason_counts", F.lit("")).alias("reason_counts"), "error")
