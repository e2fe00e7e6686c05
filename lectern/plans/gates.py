"""Gates whose conditions are data: each rule is a name and a condition that both engines read, and a row's reasons are the names of
the rules that hold. A condition that can't be told (null) counts as a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import paging
from ..operators import rules as R
from .registry import query, table


def _facts_sql(facts: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {k}" for k, e in facts.items())


def _facts(df: DataFrame, keys: list[str], facts: dict[str, str]) -> DataFrame:
    return df.select(*keys, *(F.expr(e).alias(k) for k, e in facts.items()))


# What a host reports, made up from an order's columns.
SNAPSHOT = {
    "layout": "CASE WHEN o_custkey % 41 = 0 THEN 'v0' ELSE 'v1' END",
    "age_s": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_orderkey % 40 - 6 END",
    "host": "CASE WHEN o_custkey % 23 = 1 THEN 'other' ELSE 'render' END",
    "ram_total": "6.5 + (o_orderkey % 30) * 0.1",
    "threads": "o_custkey % 10",
    "n_samples": "o_orderkey % 9",
    "ram_least": "CASE WHEN o_orderkey % 9 < 5 THEN NULL ELSE 1.5 + (o_custkey % 20) * 0.1 END",
    "disk_c": "CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE (o_orderkey % 60) * 0.1 END",
    "disk_d": "(o_custkey % 30) * 1.0",
    "temp": "CASE o_orderkey % 3 WHEN 0 THEN 'C:' WHEN 1 THEN 'D:' ELSE 'E:' END",
    "workers_known": "o_custkey % 27 <> 5",
    "n_tts": "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END",
    "n_asr": "CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END",
    "n_unknown": "CASE WHEN o_custkey % 29 = 0 THEN 1 ELSE 0 END",
    "n_workers": "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 29 = 0 THEN 1 ELSE 0 END",
    "latch": "CASE WHEN o_orderstatus = 'F' THEN 'ON' WHEN o_orderstatus = 'O' THEN 'OFF' END",
    "owner": "CASE WHEN o_custkey % 5 = 0 THEN 'UNKNOWN' ELSE 'VERIFIED' END",
    "mutex": "CASE WHEN o_orderkey % 5 = 0 THEN 'HELD' ELSE 'FREE' END",
    "stage": "CASE WHEN o_orderkey % 2 = 0 THEN 'TTS' ELSE 'ASR' END",
}


@query("resource_admission", f"WITH s AS (SELECT o_orderkey, {_facts_sql(SNAPSHOT)} FROM orders), r AS (SELECT *, {G.reasons_sql(G.ADMISSION)} AS reasons FROM s) SELECT o_orderkey, stage, reasons, reasons = '' AS eligible, CAST(len(list_filter(string_split(reasons, ','), lambda x: x <> '')) AS INT) AS n_reasons FROM r")
def resource_admission(spark: SparkSession, sf: str) -> DataFrame:
    """All nineteen checks of a snapshot, as reasons to hold."""
    s = G.judged(_facts(table(spark, sf, "orders"), ["o_orderkey"], SNAPSHOT), G.ADMISSION)
    return s.select("o_orderkey", "stage", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible"), F.size("reasons").alias("n_reasons"))


JOB = SNAPSHOT | {
    "action": "CASE o_custkey % 4 WHEN 0 THEN 'recheck' WHEN 1 THEN 'resume' WHEN 2 THEN 'improve' ELSE 'export' END",
    "state": "CASE o_orderkey % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'QUEUED_RESOURCE' WHEN 2 THEN 'WAIT_OTHER_WORKER' ELSE 'RUNNING' END",
    "owner_start": "o_custkey % 10 <> 3",
    "witness": "o_custkey % 6 <> 0",
    "barrier": "o_orderkey % 9 = 0",
    "has_snapshot": "o_custkey % 8 <> 7",
    "stage": "CASE o_custkey % 4 WHEN 0 THEN 'ASR' ELSE 'TTS' END",
}


@query("job_admission", f"WITH s AS (SELECT o_orderkey, {_facts_sql(JOB)} FROM orders), r AS (SELECT *, {G.reasons_sql(G.JOB)} AS reasons FROM s) SELECT o_orderkey, action, reasons, CASE WHEN reasons = '' THEN 'ELIGIBLE_FOR_EXISTING_AUTHORIZED_CHECKS' ELSE 'HOLD' END AS decision FROM r")
def job_admission(spark: SparkSession, sf: str) -> DataFrame:
    """A queued job's own conditions, then those of its resource snapshot; each reason once."""
    s = G.judged(_facts(table(spark, sf, "orders"), ["o_orderkey"], JOB), G.JOB)
    return s.select("o_orderkey", "action", F.array_join("reasons", ",").alias("reasons"), F.when(F.size("reasons") == 0, "ELIGIBLE_FOR_EXISTING_AUTHORIZED_CHECKS").otherwise("HOLD").alias("decision"))


FRAME = {
    "gen_a": "CASE WHEN o_custkey % 31 = 0 THEN NULL WHEN o_custkey % 31 = 1 THEN '' WHEN o_custkey % 31 = 2 THEN 'é' ELSE concat('g', CAST(o_custkey % 7 AS VARCHAR(9))) END",
    "gen_b": "CASE WHEN o_custkey % 31 = 1 THEN '' WHEN o_custkey % 31 = 2 THEN 'é' ELSE concat('g', CAST(CASE WHEN o_orderkey % 10 = 0 THEN 9 ELSE o_custkey % 7 END AS VARCHAR(9))) END",
    "t_a": "CASE WHEN o_orderkey % 33 = 7 THEN -1 ELSE o_orderkey * 10 END",
    "t_b": "o_orderkey * 10 + CASE WHEN o_custkey % 12 = 0 THEN -5 ELSE o_custkey % 250 * 150 END",
    "t_now": "CASE WHEN o_orderkey % 35 = 3 THEN NULL ELSE o_orderkey * 10 + o_custkey % 250 * 150 + o_custkey % 6000 END",
    "start": "o_custkey % 9 <> 0",
    "stop": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 14 = 0 END",
    "checkpoint": "o_custkey % 24 <> 3",
    "source": "o_custkey % 26 <> 9",
    "acked": "o_custkey % 15 <> 1",
    "released": "o_orderkey % 17 <> 4",
    "reaped": "CASE WHEN o_orderkey % 19 = 2 THEN NULL ELSE true END",
    "mutex_free": "o_orderkey % 20 <> 11",
    "unloaded": "o_orderkey % 8 <> 3",
    "n_tts": "CASE WHEN o_custkey % 18 = 2 THEN 1 ELSE 0 END",
    "n_asr": "CASE WHEN o_custkey % 22 = 2 THEN -1 ELSE 0 END",
    "n_other": "CASE WHEN o_custkey % 25 = 2 THEN NULL ELSE 0 END",
    "threads": "CASE WHEN o_custkey % 21 = 4 THEN 2 ELSE 1 END",
    "ram": "CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE (o_orderkey % 40) * 0.1 END",
    "least": "0.8 + (o_custkey % 5) * 0.1",
    "disk_c": "(o_orderkey % 50) * 0.1 - 0.2",
    "disk_d": "(o_custkey % 40) * 1.0",
}


@query("handoff_gate", f"WITH s AS (SELECT o_orderkey, {_facts_sql(FRAME)} FROM orders), r AS (SELECT *, {G.reasons_sql(G.HANDOFF)} AS reasons FROM s) SELECT o_orderkey, reasons, CASE WHEN reasons = '' THEN 'READY' ELSE 'BLOCKED' END AS status FROM r")
def handoff_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one stage may hand over to the next: identity, order and gap of the observations, owners, release, workers, resources."""
    s = G.judged(_facts(table(spark, sf, "orders"), ["o_orderkey"], FRAME), G.HANDOFF)
    return s.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), F.when(F.size("reasons") == 0, "READY").otherwise("BLOCKED").alias("status"))


@query("order_and_gaps", """WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    g AS (SELECT user_id, count(*) FILTER (WHERE ts < p) AS back, count(*) FILTER (WHERE ts >= p AND epoch_us(ts) - epoch_us(p) > 7200000000) AS wide, count(*) AS n FROM e GROUP BY user_id)
    SELECT user_id, CAST(n AS BIGINT) AS n, CAST(back AS BIGINT) AS out_of_order, CAST(wide AS BIGINT) AS wide_gaps, back = 0 AND wide = 0 AS fine FROM g""")
def order_and_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's events in their order: how many go back in time, and how many come over two hours after the one before."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.lag("ts").over(W.partitionBy("user_id").orderBy("event_id")).alias("p"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("p").cast("timestamp"))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(gap < 0).alias("out_of_order"), F.count_if(gap > 7_200_000_000).alias("wide_gaps"))
    return g.withColumn("fine", (F.col("out_of_order") == 0) & (F.col("wide_gaps") == 0))


# Measures of a rendered chunk, made up from a line's columns.
CHUNK = {
    "file_bytes": "CASE WHEN l_partkey % 61 = 0 THEN NULL ELSE (l_partkey * 37) % 40000 END",
    "decode_error": "l_suppkey % 19 = 3",
    "rms_db": "-20.0 - (l_partkey % 33)",
    "clipping": "(l_orderkey % 50) * 0.0005",
    "n_text": "300 + (l_partkey % 500)",
    "seconds": "4.0 + (l_orderkey % 20)",
    "silence_s": "(l_partkey % 30) * 0.1",
    "lead_s": "(l_orderkey % 9) * 0.1",
    "trail_s": "(l_suppkey % 8) * 0.1",
    "rate": "90.0 + (l_partkey % 100)",
    "phrase": "CASE WHEN l_linenumber % 2 = 0 THEN 0.7 + (l_orderkey % 30) * 0.01 END",
    "repair": "l_suppkey % 11 = 0",
    "heard": "l_orderkey % 37 <> 0",
    "similarity": "0.4 + (l_partkey % 60) * 0.01",
    "confidence": "0.3 + (l_orderkey % 70) * 0.01",
    "unclear": "CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END",
}
_fine = "file_bytes >= 1024 AND NOT decode_error AND"
# The thresholds of the thirteen rules.
EVENTS = {
    "missing_audio:error": "coalesce(file_bytes, 0) < 1024",
    "decode:error": "file_bytes >= 1024 AND decode_error",
    "acoustic:error": f"{_fine} rms_db < -48",
    "clipping:error": f"{_fine} clipping > 0.02",
    "clipping:warning": f"{_fine} clipping > 0.002 AND clipping <= 0.02",
    "duration:error": f"{_fine} n_text > 500 AND seconds < 8",
    "silence:warning": f"{_fine} silence_s > 2.2",
    "join_discontinuity:error": f"{_fine} gap_s > 1.2",
    "join_discontinuity:warning": f"{_fine} gap_s > 0.65 AND gap_s <= 1.2",
    "prosody:warning": f"{_fine} (rate < 95 OR rate > 165)",
    "must_check:warning": f"{_fine} phrase < 0.82",
    "pronunciation_repair:info": f"{_fine} heard AND repair",
    "asr:error": f"{_fine} heard AND similarity < 0.55",
    "asr:warning": f"{_fine} heard AND similarity >= 0.55 AND similarity < 0.76",
    "confidence:warning": f"{_fine} heard AND (confidence < 0.45 OR unclear > 0)",
    "asr_failed:warning": f"{_fine} NOT heard",
}
_CHUNK_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
_chunk_order = ", ".join(_CHUNK_KEYS[1:])
_CHUNKS_SQL = f"m AS (SELECT {', '.join(_CHUNK_KEYS)}, {_facts_sql(CHUNK)} FROM lineitem), c AS (SELECT *, coalesce(round(lag(CASE WHEN file_bytes >= 1024 AND NOT decode_error THEN trail_s END) OVER (PARTITION BY l_orderkey ORDER BY {_chunk_order}) + lead_s, 6), 0) AS gap_s FROM m), e AS (SELECT *, list_filter([{', '.join(f'''CASE WHEN {need} THEN '{name}' END''' for name, need in EVENTS.items())}], lambda x: x IS NOT NULL) AS es FROM c)"


def _chunk_events(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of an order in their order, with the events that fire. A join's gap is the silence before it and behind the last."""
    c = _facts(table(spark, sf, "lineitem"), _CHUNK_KEYS, CHUNK)
    before = F.lag(F.expr("CASE WHEN file_bytes >= 1024 AND NOT decode_error THEN trail_s END")).over(W.partitionBy("l_orderkey").orderBy(*_CHUNK_KEYS[1:]))
    c = c.withColumn("gap_s", F.coalesce(F.round(before + F.col("lead_s"), 6), F.lit(0.0)))
    return c.select(*_CHUNK_KEYS, R.reasons({name: F.expr(need) for name, need in EVENTS.items()}).alias("es"))


@query("chunk_event_rules", f"WITH {_CHUNKS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split_part(x, ':', 1) AS event_type, split_part(x, ':', 2) AS severity FROM (SELECT *, unnest(es) AS x FROM e)")
def chunk_event_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All thirteen rules of a chunk (some at two levels): each that fires is a row."""
    e = _chunk_events(spark, sf).withColumn("x", F.explode("es"))
    part = lambda k: F.split_part("x", F.lit(":"), F.lit(k))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", part(1).alias("event_type"), part(2).alias("severity"))


@query("chunk_totals", f"""WITH {_CHUNKS_SQL}, n AS (SELECT l_orderkey, len(list_filter(es, lambda x: x LIKE '%:error')) AS er, len(list_filter(es, lambda x: x LIKE '%:warning')) AS w FROM e)
    SELECT l_orderkey, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(er) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings, CASE WHEN sum(er) + sum(w) = 0 THEN 'passed' ELSE 'review' END AS status FROM n GROUP BY l_orderkey""")
def chunk_totals(spark: SparkSession, sf: str) -> DataFrame:
    """An order passes only without warnings and errors."""
    count = lambda level: F.sum(F.size(F.filter("es", lambda x: x.endswith(level)))).cast("long")
    n = _chunk_events(spark, sf).groupBy("l_orderkey").agg(F.count("*").alias("chunks"), count(":error").alias("errors"), count(":warning").alias("warnings"))
    return n.withColumn("status", F.when(F.col("errors") + F.col("warnings") == 0, "passed").otherwise("review"))


# Segments of a conversation with the gap behind each, made up.
SEGMENT = {
    "gap_ms": "CASE (conv_id + turn) % 5 WHEN 0 THEN 1500 WHEN 1 THEN 300 ELSE 650 END",
    "gap_seconds": "CASE (conv_id + turn) % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 0.3 ELSE 0.65 END + CASE WHEN conv_id % 23 = 3 THEN 0.005 ELSE 0.004 END - 0.001",
    "structural": "turn % 4 = 0",
    "edge_start": "((conv_id * 7 + turn * 3) % 100) * 0.0005",
    "edge_end": "((conv_id + turn * 3) % 100) * -0.0005",
    "rate": "24000",
    "gap_rate": "CASE WHEN (conv_id + turn) % 30 = 7 THEN 22050 ELSE 24000 END",
    "head": "0.002 + ((conv_id * 3 + turn) % 40) * 0.001",
    "tail": "0.002 + ((conv_id + turn * 11) % 90) * 0.001",
    "directed": "(conv_id + turn) % 6 <> 0",
}
EVIDENCE = {"status": "CASE WHEN turn % 7 = 3 THEN 'REVIEW' ELSE 'PASS' END", "expected": "CASE WHEN turn % 9 = 5 THEN concat(text, ' x') ELSE upper(text) END"}
RECEIPT = {"source_ok": "conv_id % 19 <> 1", "output_ok": "conv_id % 17 <> 2", "whole_chapter_approved": "conv_id % 4 = 1"}
_CANONICAL = "CASE WHEN (conv_id + turn) % 8 = 1 THEN concat('ABC ', text) ELSE text END"
_HAS_RECEIPT, _HAS_EVIDENCE = "conv_id % 3 <> 0", "conv_id % 21 <> 20 OR turn <> 0"


@query("evidence_audit", rf"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index FROM conversations), s AS (SELECT conv_id, index, text, {_CANONICAL} AS canonical, {_facts_sql(SEGMENT)} FROM i),
    q AS (SELECT conv_id, index, {_facts_sql(EVIDENCE)} FROM i WHERE {_HAS_EVIDENCE}), v AS (SELECT DISTINCT conv_id, {_facts_sql(RECEIPT)}, [CAST(conv_id % 5 AS BIGINT)] AS changed FROM conversations WHERE {_HAS_RECEIPT}),
    n AS (SELECT conv_id, count(*) AS n, max(abs(gap_seconds * 1000 - gap_ms) > 4) AS gap_bad FROM s GROUP BY conv_id), m AS (SELECT conv_id, count(*) AS n FROM q GROUP BY conv_id),
    k AS (SELECT n.conv_id, v.conv_id IS NOT NULL AS has, coalesce(whole_chapter_approved, false) AS approved, CASE WHEN m.n IS DISTINCT FROM n.n THEN 'WHISPER_QC_INCOMPLETE' WHEN gap_bad THEN 'GAP_LENGTH_INVALID' WHEN NOT source_ok THEN 'SOURCE_HASH_MISMATCH' WHEN NOT output_ok THEN 'REVIEW_HASH_MISMATCH'
      WHEN changed[1] >= n.n THEN 'REPAIR_INDEX_INVALID' END AS error FROM n LEFT JOIN m USING (conv_id) LEFT JOIN v ON v.conv_id = n.conv_id),
    same AS (SELECT conv_id, index, status, trim(regexp_replace(replace(lower(expected), 'ß', 'ss'), '\s+', ' ', 'g')) AS said FROM q),
    j AS (SELECT s.*, status, said, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS meant, regexp_matches(canonical, '(^|[^\p{{L}}\p{{N}}_])[A-ZĐ]{{2,6}}($|[^\p{{L}}\p{{N}}_])') AS abbreviated, lag(tail) OVER (PARTITION BY s.conv_id ORDER BY s.index) AS tail_before
      FROM s JOIN k ON k.conv_id = s.conv_id AND k.error IS NULL LEFT JOIN same ON s.conv_id = same.conv_id AND s.index = same.index),
    f AS (SELECT conv_id, unnest(list_filter([{', '.join(f"CASE WHEN {need} THEN '{name}' END" for name, need in G.FINDINGS.items())}], lambda x: x IS NOT NULL)) AS x FROM j),
    g AS (SELECT conv_id, gap_ms, count(*) AS n FROM j GROUP BY ALL), d AS (SELECT conv_id, max(n) / sum(n) AS share FROM g GROUP BY conv_id),
    a AS (SELECT conv_id, x FROM f UNION ALL SELECT conv_id, 'QC01_PAUSE:PAUSE_DISTRIBUTION_DOMINATED' FROM d WHERE share > 0.7 UNION ALL SELECT conv_id, CASE WHEN has THEN 'QC05_POST_REPAIR:WHOLE_CHAPTER_LISTENING_PENDING' ELSE 'QC05_POST_REPAIR:REPAIR_RECEIPT_NOT_PROVIDED' END FROM k WHERE error IS NULL AND NOT approved),
    c AS (SELECT conv_id, split_part(x, ':', 1) AS stage, split_part(x, ':', 2) AS code, count(*) AS n FROM a GROUP BY ALL),
    t AS (SELECT conv_id, error, stage FROM k, (SELECT unnest({G.DIMENSIONS}) AS stage))
    SELECT t.conv_id, t.stage, CASE WHEN any_value(error) IS NOT NULL THEN 'INVALID' WHEN sum(n) > 0 THEN 'REVIEW' ELSE 'MEASURED_NOT_HUMAN_VERIFIED' END AS status, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings, coalesce(string_agg(code || '=' || n, ',' ORDER BY code), '') AS reason_counts, any_value(error) AS error
    FROM t LEFT JOIN c ON t.conv_id = c.conv_id AND t.stage = c.stage GROUP BY t.conv_id, t.stage""")
def evidence_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Five dimensions of each conversation: findings of every segment, joined with its evidence and the segment before, the share of
    the commonest pause, the receipt after repair, and how often each reason occurs."""
    c = table(spark, sf, "conversations").withColumn("index", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    segments = c.select("conv_id", "index", F.expr(_CANONICAL).alias("canonical_text"), F.col("text").alias("spoken_text"), *(F.expr(e).alias(k) for k, e in SEGMENT.items()))
    evidence = c.where(_HAS_EVIDENCE).select("conv_id", "index", *(F.expr(e).alias(k) for k, e in EVIDENCE.items()))
    receipts = c.where(_HAS_RECEIPT).select("conv_id", *(F.expr(e).alias(k) for k, e in RECEIPT.items()), F.array(F.col("conv_id") % 5).alias("changed")).distinct()
    return G.audit(segments, evidence, receipts, "conv_id")


@query("request_kind_zero", "SELECT page_id % 50 AS host, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/en/7') AS BIGINT) AS of_kind, count(*) FILTER (WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/en/7') = 0 AS accepted FROM pages GROUP BY 1")
def request_kind_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted only where no request is of the kind that its path tells."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    g = table(spark, sf, "pages").groupBy((F.col("page_id") % 50).alias("host")).agg(F.count("*").alias("requests"), F.count_if(path == "/en/7").alias("of_kind"))
    return g.withColumn("accepted", F.col("of_kind") == 0)


#: Roles of elements without one, by their tag.
ROLES = {"button": "button", "a": "link", "textarea": "textbox", "input": "textbox", "select": "combobox"}
ELEMENT = {
    "tag": "CASE p_partkey % 7 WHEN 0 THEN 'button' WHEN 1 THEN 'a' WHEN 2 THEN 'textarea' WHEN 3 THEN 'input' WHEN 4 THEN 'select' ELSE 'div' END",
    "own_role": "CASE WHEN p_partkey % 11 = 0 THEN 'slider' END",
    "aria": "CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE '' END",
    "label": "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END",
    "hint": "CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END",
    "test_id": "CASE WHEN p_partkey % 13 = 0 THEN concat('t', CAST(p_size AS VARCHAR(9))) ELSE '' END",
    "control": "CASE WHEN p_type LIKE '%BRASS' THEN 'editor' WHEN p_size BETWEEN 1 AND 10 THEN 'slider_unresolved' WHEN p_brand = 'Brand#11' THEN 'login' WHEN p_size BETWEEN 20 AND 30 THEN 'format' END",
}
_ROLE_SQL = "coalesce(own_role, CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " END)"
_NAME_SQL = "coalesce(nullif(aria, ''), nullif(label, ''), nullif(hint, ''), '')"
# The priorities of the ways to find an element.
LOCATORS = {
    "10": ("test_id", "test_id <> ''", "test_id"),
    "20": ("role_name", "role IS NOT NULL AND name <> ''", "concat(role, '/', name)"),
    "30": ("aria_label", "aria <> ''", "aria"),
    "40": ("placeholder", "hint <> '' AND tag IN ('input', 'textarea')", "hint"),
    "75": ("role", "role = 'slider'", "'slider'"),
    "80": ("text", "label <> '' AND tag IN ('button', 'a')", "label"),
}
_ELEMENTS_SQL = f"e AS (SELECT p_partkey, {_facts_sql(ELEMENT)} FROM part), n AS (SELECT *, {_ROLE_SQL} AS role, {_NAME_SQL} AS name FROM e)"
_FOUND_SQL = "c AS (" + " UNION ALL ".join(f"SELECT p_partkey, control, {k} AS priority, '{way}' AS way, {value} AS value FROM n WHERE {need}" for k, (way, need, value) in LOCATORS.items()) + ")"


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    e = _facts(table(spark, sf, "part"), ["p_partkey"], ELEMENT)
    roles = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    name = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("aria", "label", "hint")), F.lit(""))
    return e.withColumns({"role": F.coalesce("own_role", F.try_element_at(roles, F.col("tag"))), "name": name})


def _locators(elements: DataFrame) -> DataFrame:
    """(p_partkey, control, priority, way, value) of every way to find an element."""
    ways = [F.when(F.expr(need), F.struct(F.lit(int(k)).alias("priority"), F.lit(way).alias("way"), F.expr(value).alias("value"))) for k, (way, need, value) in LOCATORS.items()]
    return elements.select("p_partkey", "control", F.explode(F.array_compact(F.array(*ways))).alias("l")).select("p_partkey", "control", "l.*")


@query("locator_rank", f"WITH {_ELEMENTS_SQL}, {_FOUND_SQL} SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY priority) AS INT) AS rank, way, value FROM c")
def locator_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The ways to find an element, the steadiest first; role and name fall back on tag, label and hint."""
    rank = F.row_number().over(W.partitionBy("p_partkey").orderBy("priority"))
    return _locators(_elements(spark, sf)).select("p_partkey", rank.alias("rank"), "way", "value")


@query("surface_map", f"""WITH {_ELEMENTS_SQL}, {_FOUND_SQL}, u AS (SELECT DISTINCT control, priority, way, value FROM c WHERE control IS NOT NULL),
    l AS (SELECT control, count(*) AS n, first(way || ':' || value ORDER BY priority, way, value) AS best FROM u GROUP BY control),
    k AS (SELECT control, count(*) AS n FROM n WHERE control IS NOT NULL GROUP BY control)
    SELECT k.control, CAST(k.n AS BIGINT) AS controls, CAST(coalesce(l.n, 0) AS BIGINT) AS locators, best, k.control = 'slider_unresolved' AS unresolved FROM k LEFT JOIN l ON k.control = l.control""")
def surface_map(spark: SparkSession, sf: str) -> DataFrame:
    """Elements by what they control: how many, how many different ways lead to them, and the best of these."""
    e = _elements(spark, sf).where("control is not null")
    ways = _locators(e).select("control", "priority", "way", "value").distinct()
    best = F.min(F.struct("priority", "way", "value"))
    per = ways.groupBy("control").agg(F.count("*").alias("locators"), best.alias("b")).select("control", "locators", F.concat_ws(":", "b.way", "b.value").alias("best"))
    out = e.groupBy("control").agg(F.count("*").alias("controls")).join(per, "control", "left").fillna({"locators": 0})
    return out.select("control", "controls", "locators", "best", (F.col("control") == "slider_unresolved").alias("unresolved"))


#: Fixed labels of settings and the keys they are filed under.
SETTINGS = {"economy": "speed", "standard": "stability", "promo": "expression", "small": "pause"}


@query("catalog_assembly", """WITH s AS (SELECT p_brand, lower(split_part(p_type, ' ', 1)) AS label, p_partkey, p_name, p_size, p_size % 7 = 0 AS chosen, p_partkey % 40 <> 0 AS opened FROM part),
    k AS (SELECT *, CASE label WHEN 'economy' THEN 'speed' WHEN 'standard' THEN 'stability' WHEN 'promo' THEN 'expression' WHEN 'small' THEN 'pause' END AS key FROM s),
    g AS (SELECT p_brand, key, count(*) AS n, count(*) FILTER (WHERE chosen) AS n_chosen, arg_min(p_name, p_partkey) FILTER (WHERE chosen) AS selected, bool_and(opened) AS opened FROM k WHERE key IS NOT NULL GROUP BY ALL)
    SELECT p_brand, key, CAST(n AS BIGINT) AS option_count, selected, concat_ws(',', CASE WHEN n_chosen = 0 THEN 'nothing_selected' END, CASE WHEN n_chosen > 1 THEN 'several_selected' END, CASE WHEN NOT opened THEN 'not_opened' END) AS warnings FROM g""")
def catalog_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Labels mapped to keys, the selected option of each, counts and warnings. Unknown labels are no settings."""
    keys = F.create_map(*(F.lit(x) for pair in SETTINGS.items() for x in pair))
    s = table(spark, sf, "part").withColumn("key", F.try_element_at(keys, F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))))).where("key is not null")
    chosen = F.col("p_size") % 7 == 0
    g = s.groupBy("p_brand", "key").agg(F.count("*").alias("option_count"), F.count_if(chosen).alias("n"), F.min_by("p_name", F.when(chosen, F.col("p_partkey"))).alias("selected"), F.bool_and(F.col("p_partkey") % 40 != 0).alias("opened"))
    why = R.reasons({"nothing_selected": F.col("n") == 0, "several_selected": F.col("n") > 1, "not_opened": ~F.col("opened")})
    return g.select("p_brand", "key", "option_count", F.when(F.col("n") > 0, F.col("selected")).alias("selected"), F.array_join(why, ",").alias("warnings"))


#: Fixed calibrations: ratio and what the surface shows for it.
STABILITY = [(0.2, 30.0), (0.45, 50.0), (0.7, 75.0), (0.9, 95.0)]
SPEED = [(0.25, 0.75), (0.5, 1.0), (0.75, 1.25)]
_near_sql = lambda points, x: f"list_extract(list_sort(list_transform([{', '.join(f'[{r}, {v}]' for r, v in points)}], lambda p: [abs(p[1] - {x}), p[1], p[2]])), 1)"


@query("preset_description", f"""WITH p AS (SELECT p_partkey, p_brand AS preset, round((p_size % 21) / 20.0, 2) AS stability, round((p_partkey % 21) / 20.0, 2) AS speed FROM part),
    n AS (SELECT *, {_near_sql(STABILITY, "stability")} AS a, {_near_sql(SPEED, "speed")} AS b FROM p)
    SELECT p_partkey, preset, stability, a[2] AS stability_reference, a[3] AS stability_value, speed, b[2] AS speed_reference, b[3] AS speed_value, CASE WHEN s_suppkey IS NULL THEN 'unknown' ELSE s_name END AS voice
    FROM n LEFT JOIN supplier ON p_partkey % 7 = s_suppkey""")
def preset_description(spark: SparkSession, sf: str) -> DataFrame:
    """A preset with its voice and the nearest calibrated point of each ratio, ties to the smaller."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("preset"), F.round((F.col("p_size") % 21) / 20.0, 2).alias("stability"), F.round((F.col("p_partkey") % 21) / 20.0, 2).alias("speed"))

    def near(points: list[tuple[float, float]], x: str):
        return F.array_min(F.array(*(F.struct(F.abs(F.lit(r) - F.col(x)).alias("d"), F.lit(r).alias("r"), F.lit(v).alias("v")) for r, v in points)))

    n = p.withColumns({"a": near(STABILITY, "stability"), "b": near(SPEED, "speed")})
    voices = table(spark, sf, "supplier").where("s_suppkey < 7").select("s_suppkey", "s_name")  # seven rows
    j = n.join(F.broadcast(voices), F.col("p_partkey") % 7 == F.col("s_suppkey"), "left")
    return j.select("p_partkey", "preset", "stability", F.col("a.r").alias("stability_reference"), F.col("a.v").alias("stability_value"), "speed", F.col("b.r").alias("speed_reference"), F.col("b.v").alias("speed_value"), F.coalesce("s_name", F.lit("unknown")).alias("voice"))


@query("page_fill_pages", """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    f AS (SELECT source, doc_id, n_chars, i, 1 AS page, 1 AS ordinal, n_chars AS running FROM d WHERE i = 1
      UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.i, CASE WHEN f.ordinal < 16 AND f.running + d.n_chars <= 30000 THEN f.page ELSE f.page + 1 END, CASE WHEN f.ordinal < 16 AND f.running + d.n_chars <= 30000 THEN f.ordinal + 1 ELSE 1 END,
        CASE WHEN f.ordinal < 16 AND f.running + d.n_chars <= 30000 THEN f.running + d.n_chars ELSE d.n_chars END FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
    SELECT source, doc_id, CAST(page AS BIGINT) AS page, CAST(ordinal AS BIGINT) AS ordinal, CAST(running AS BIGINT) AS running FROM f""")
def page_fill_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's page: pages of a source have at most 16 documents and 30,000 characters, or one longer document."""
    return paging.fill_pages(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 16, 30_000)
