"""Rule classification queries: classes, envelopes, gates, validations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import beats as B
from ..functions import genre as N
from ..functions import text as X
from ..operators import contracts as C
from ..operators import rules as R
from ..operators import terms
from .registry import query, table
from .segments import directed


# Profile envelopes: words a minute, pause ratio, pitch in semitones, energy in dB (least and most of each).
ENVELOPES = [
    ("BUSINESS_CLEAR", 120.0, 180.0, 0.06, 0.28, 0.65, 4.8, 1.5, 12.0),
    ("STORY_NARRATIVE", 95.0, 165.0, 0.08, 0.36, 1.0, 6.5, 2.0, 15.0),
    ("GENERAL_CLEAR", 110.0, 175.0, 0.06, 0.32, 0.75, 5.5, 1.5, 13.0),
]
MEASURES = ("rate", "pause", "pitch", "energy")
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
_KEY = ", ".join(KEY)


@query("genre_classify", N.classify_sql("documents", "doc_id", N.EUROPEAN))
def genre_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Genre by counted terms, with its profile, tone, capped confidence, densities and evidence."""
    d = N.classify(table(spark, sf, "documents").select("doc_id", "text"), "text", N.EUROPEAN)
    return d.select("doc_id", "genre", "subgenre", "profile", F.array_join("tone", ",").alias("tone"), "confidence", "dialogue_density", "technical_density", F.array_join("evidence", ",").alias("evidence"))


@query("beat_classify", f"""WITH n AS (SELECT conv_id, turn, text AS t, CASE WHEN turn % 7 = 6 THEN ' narrative' END AS given FROM conversations), h AS (SELECT *, {B.searched_sql('t', B.COMMON)} AS s FROM n), f AS (SELECT *, {B.beat_sql('t', 's', B.COMMON)} AS b FROM h),
    g AS (SELECT conv_id, turn, CASE WHEN given IS NULL THEN b.beat ELSE upper(trim(given)) END AS beat, CASE WHEN given IS NULL THEN array_to_string(b.cues, ',') ELSE 'explicit_beat' END AS cues, CASE WHEN given IS NULL THEN b.confidence ELSE 1.0 END AS confidence FROM f),
    p AS (SELECT * FROM (VALUES {_values(B.POLICIES)}) t(beat, pause_before_ms, pause_after_ms, emphasis, energy))
    SELECT conv_id, turn, beat, cues, CAST(confidence AS DOUBLE) AS confidence, CAST(pause_before_ms AS INT) AS pause_before_ms, CAST(pause_after_ms AS INT) AS pause_after_ms, emphasis, energy FROM g JOIN p USING (beat)""")
def beat_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each turn by cues, or that given (here of every seventh turn), joined with the class's delivery policy."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 7 == 6, " narrative").alias("given"))
    d = directed(B.with_beat(c, "text", B.COMMON, "given"))
    return d.select("conv_id", "turn", "beat", F.array_join("cues", ",").alias("cues"), "confidence", "pause_before_ms", "pause_after_ms", "emphasis", "energy")


@query("unit_pause_policy", rf"""WITH n AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?…\n]+[.!?…]*'), lambda x: trim(x)), lambda x: x <> '')) AS t FROM documents),
    h AS (SELECT *, {B.searched_sql('t', B.COMMON)} AS s FROM n), f AS (SELECT doc_id, t, {B.beat_sql('t', 's', B.COMMON)} AS b FROM h)
    SELECT doc_id, b.beat AS beat, CAST(count(*) AS BIGINT) AS n, CAST(sum({B.pause_sql('t', 'b.beat')}) AS BIGINT) AS pause_ms FROM f GROUP BY doc_id, b.beat""")
def unit_pause_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Pause by closing mark, adjusted by class, capped; added up by document and class."""
    s = B.with_beat(table(spark, sf, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s")), "s", B.COMMON)
    s = s.withColumn("p", B.pause_after(F.col("s"), F.col("beat")))
    return s.groupBy("doc_id", "beat").agg(F.count("*").alias("n"), F.sum("p").cast("long").alias("pause_ms"))


# A stand-in for measured chunks: every line item has a profile and four measures, some missing.
_MEASURED_SQL = f"""m AS (SELECT {_KEY}, list_extract(['BUSINESS_CLEAR', 'STORY_NARRATIVE', 'GENERAL_CLEAR'], CAST(l_suppkey % 3 AS INT) + 1) AS profile, l_linenumber AS attempt,
    CASE WHEN l_partkey % 11 <> 0 THEN 80 + l_quantity * 2.5 END AS rate, CASE WHEN l_partkey % 13 <> 0 THEN l_discount * 4 END AS pause, CASE WHEN l_partkey % 17 <> 0 THEN l_tax * 90 END AS pitch, CASE WHEN l_partkey % 19 <> 0 THEN l_linenumber * 2.4 END AS energy,
    CASE WHEN l_partkey % 7 <> 0 THEN 0.6 + l_discount * 4 END AS similarity, CASE WHEN l_partkey % 5 <> 0 THEN 0.4 + l_tax * 7 END AS word_confidence, CASE WHEN l_partkey % 23 <> 0 THEN l_discount / 10 END AS clipping FROM lineitem)"""


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    unless = lambda n, v: F.when(F.col("l_partkey") % n != 0, v)
    profile = F.element_at(F.array(*(F.lit(e[0]) for e in ENVELOPES)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return d.select(
        *KEY, profile.alias("profile"), F.col("l_linenumber").alias("attempt"),
        unless(11, 80 + F.col("l_quantity") * 2.5).alias("rate"), unless(13, F.col("l_discount") * 4).alias("pause"), unless(17, F.col("l_tax") * 90).alias("pitch"), unless(19, F.col("l_linenumber") * 2.4).alias("energy"),
        unless(7, 0.6 + F.col("l_discount") * 4).alias("similarity"), unless(5, 0.4 + F.col("l_tax") * 7).alias("word_confidence"), unless(23, F.col("l_discount") / 10).alias("clipping"),
    )


_OUT = ", ".join(f"CASE WHEN {m} IS NULL THEN '{m}_missing' END, CASE WHEN {m} < {m}_lo THEN '{m}_low' END, CASE WHEN {m} > {m}_hi THEN '{m}_high' END" for m in MEASURES)


@query("envelope_eval", f"""WITH {_MEASURED_SQL}, e AS (SELECT * FROM (VALUES {_values(ENVELOPES)}) t(profile, {", ".join(f"{m}_lo, {m}_hi" for m in MEASURES)})),
    r AS (SELECT {_KEY}, profile, concat_ws(',', {_OUT}) AS reasons FROM m JOIN e USING (profile))
    SELECT {_KEY}, profile, reasons, CASE WHEN reasons = '' THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM r""")
def envelope_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Four measures against the ranges of the row's profile."""
    schema = "profile string, " + ", ".join(f"{m}_lo double, {m}_hi double" for m in MEASURES)
    rows = _measured(spark, sf).join(F.broadcast(spark.createDataFrame(ENVELOPES, schema)), "profile")
    rules: dict = {}
    for m in MEASURES:
        rules |= R.outside(m, F.col(m), F.col(f"{m}_lo"), F.col(f"{m}_hi"))
    found = F.array_join(R.reasons(rules), ",")
    return rows.select(*KEY, "profile", found.alias("reasons"), F.when(found == "", "PASS").otherwise("REVIEW").alias("verdict"))


_QUALITY = """
    q AS (SELECT *, coalesce(similarity < 0.72, false) OR coalesce(word_confidence < 0.45, false) AS hard, coalesce(similarity < 0.88, false) OR coalesce(word_confidence < 0.68, false) AS soft,
      coalesce(rate < 95, false) OR coalesce(rate > 185, false) OR coalesce(pause < 0.05, false) OR coalesce(pause > 0.34, false) OR coalesce(pitch < 0.8, false) AS style, coalesce(clipping > 0.005, false) AS clip,
      similarity IS NULL OR word_confidence IS NULL OR rate IS NULL OR pause IS NULL OR pitch IS NULL OR clipping IS NULL AS missing FROM m)"""


@query("quality_classify", f"""WITH {_MEASURED_SQL}, {_QUALITY},
    s AS (SELECT *, attempt < 3 AS retry, hard OR soft OR style OR clip AS bad FROM q)
    SELECT {_KEY}, CASE WHEN bad THEN (CASE WHEN retry THEN 'REPAIR' ELSE 'REVIEW' END) WHEN missing THEN 'REVIEW' ELSE 'PASS' END AS status,
      concat_ws(',', CASE WHEN hard THEN 'pronunciation_unclear' END, CASE WHEN soft AND NOT hard THEN 'pronunciation_suspect' END, CASE WHEN style THEN 'prosody_style_mismatch' END, CASE WHEN clip THEN 'clipping' END, CASE WHEN bad AND NOT retry THEN 'retry_budget_exhausted' END, CASE WHEN NOT bad AND missing THEN 'metrics_incomplete' END) AS findings,
      CASE WHEN bad AND retry THEN concat_ws(',', CASE WHEN hard OR soft THEN 'spoken_form' END, CASE WHEN hard OR soft THEN 'split_chunk' END, CASE WHEN hard OR soft THEN 'rerender' END, CASE WHEN style THEN 'adjust_pace' END, CASE WHEN NOT (hard OR soft) THEN 'rerender' END) ELSE '' END AS actions FROM s""")
def quality_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Three tri-state dimensions, a retry budget, findings and repair actions."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    hard = yes(c("similarity") < 0.72) | yes(c("word_confidence") < 0.45)
    soft = yes(c("similarity") < 0.88) | yes(c("word_confidence") < 0.68)
    style = yes(c("rate") < 95) | yes(c("rate") > 185) | yes(c("pause") < 0.05) | yes(c("pause") > 0.34) | yes(c("pitch") < 0.8)
    clip, retry = yes(c("clipping") > 0.005), c("attempt") < 3
    missing = F.greatest(*(c(m).isNull() for m in ("similarity", "word_confidence", "rate", "pause", "pitch", "clipping")))
    bad, spoken = hard | soft | style | clip, hard | soft
    findings = R.reasons({"pronunciation_unclear": hard, "pronunciation_suspect": soft & ~hard, "prosody_style_mismatch": style, "clipping": clip, "retry_budget_exhausted": bad & ~retry, "metrics_incomplete": ~bad & missing})
    actions = F.array_distinct(F.array_compact(F.array(F.when(spoken, "spoken_form"), F.when(spoken, "split_chunk"), F.when(spoken, "rerender"), F.when(style, "adjust_pace"), F.when(bad, "rerender"))))
    status = F.when(bad & retry, "REPAIR").when(bad | missing, "REVIEW").otherwise("PASS")
    return _measured(spark, sf).select(*KEY, status.alias("status"), F.array_join(findings, ",").alias("findings"), F.when(bad & retry, F.array_join(actions, ",")).otherwise("").alias("actions"))


@query("qc_event_rules", f"""WITH {_MEASURED_SQL}, e AS (SELECT {_KEY}, unnest([CASE WHEN clipping > 0.004 THEN 'clipping:error' WHEN clipping > 0.002 THEN 'clipping:warning' END, CASE WHEN pause > 0.3 THEN 'silence:warning' END,
      CASE WHEN similarity < 0.62 THEN 'asr:error' WHEN similarity < 0.76 THEN 'asr:warning' END, CASE WHEN word_confidence < 0.45 THEN 'confidence:warning' END]) AS e FROM m)
    SELECT {_KEY}, split_part(e, ':', 1) AS event_type, split_part(e, ':', 2) AS severity FROM e WHERE e IS NOT NULL""")
def qc_event_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Each rule that fires is an event row."""
    c = F.col
    fired = F.array_compact(F.array(
        F.when(c("clipping") > 0.004, "clipping:error").when(c("clipping") > 0.002, "clipping:warning"), F.when(c("pause") > 0.3, "silence:warning"),
        F.when(c("similarity") < 0.62, "asr:error").when(c("similarity") < 0.76, "asr:warning"), F.when(c("word_confidence") < 0.45, "confidence:warning"),
    ))
    e = _measured(spark, sf).select(*KEY, F.explode(fired).alias("e"))
    return e.select(*KEY, F.split_part("e", F.lit(":"), F.lit(1)).alias("event_type"), F.split_part("e", F.lit(":"), F.lit(2)).alias("severity"))


@query("five_gate_rollup", f"""WITH {_MEASURED_SQL}, g AS (SELECT profile, unnest(['rate', 'pause', 'pitch', 'clipping', 'similarity']) AS stage, unnest([rate > 185, pause > 0.3, pitch < 0.8, clipping > 0.004, similarity < 0.76]) AS bad FROM m)
    SELECT profile, stage, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_bad, CAST(count(*) FILTER (WHERE bad IS NULL) AS BIGINT) AS n_unknown, CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN 'PASS' WHEN count(*) FILTER (WHERE bad) * 10 < count(*) THEN 'REVIEW' ELSE 'FAIL' END AS status FROM g GROUP BY profile, stage""")
def five_gate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    gates = {"rate": c("rate") > 185, "pause": c("pause") > 0.3, "pitch": c("pitch") < 0.8, "clipping": c("clipping") > 0.004, "similarity": c("similarity") < 0.76}
    rows = _measured(spark, sf).select("profile", F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), v.alias("bad")) for k, v in gates.items()))).alias("g"))
    out = rows.groupBy("profile", "g.stage").agg(F.count("*").alias("n"), F.count_if("g.bad").alias("n_bad"), F.count_if(F.col("g.bad").isNull()).alias("n_unknown"))
    return out.withColumn("status", F.when(c("n_bad") == 0, "PASS").when(c("n_bad") * 10 < c("n"), "REVIEW").otherwise("FAIL"))


@query("page_state_classify", """SELECT page_id, CASE WHEN contains(lower(html), 'captcha') OR contains(lower(html), 'cloudflare') THEN 'CHALLENGE' WHEN contains(lower(html), '<form') AND contains(lower(html), 'password') THEN 'LOGIN' WHEN contains(lower(html), '<article') THEN 'CONTENT' WHEN contains(lower(html), '<nav') THEN 'INDEX' ELSE 'UNKNOWN' END AS state,
    CASE WHEN contains(lower(html), 'logout') THEN 'AUTHENTICATED' WHEN contains(lower(html), 'login') THEN 'ANONYMOUS' ELSE 'UNKNOWN' END AS auth FROM pages""")
def page_state_classify(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda t: F.contains(F.lower("html"), F.lit(t))
    state = F.when(has("captcha") | has("cloudflare"), "CHALLENGE").when(has("<form") & has("password"), "LOGIN").when(has("<article"), "CONTENT").when(has("<nav"), "INDEX").otherwise("UNKNOWN")
    return table(spark, sf, "pages").select("page_id", state.alias("state"), F.when(has("logout"), "AUTHENTICATED").when(has("login"), "ANONYMOUS").otherwise("UNKNOWN").alias("auth"))


#: Names that elements have here: known ones in other forms, and unknown ones.
NAMES = ["VI", " Tự  động", "TẠO GIỌNG NÓI", "tạo giọng", "Generate", "Cài đặt", "lịch sử", "Đang tắt", "Thêm người nói", "nhập kịch bản", "Phụ đề thành giọng nói", "chat với trợ lý", "MP3", "wav", "Đăng nhập để xem lịch sử", "Sign In", "loginx", ""]
_ELEMENT = {"role": "CASE p_partkey % 9 WHEN 0 THEN 'tab' WHEN 1 THEN 'slider' WHEN 2 THEN 'textbox' WHEN 3 THEN NULL ELSE 'button' END", "editable": "CASE WHEN p_size % 10 = 0 THEN true WHEN p_size % 10 = 1 THEN NULL ELSE false END", "value_now": "CASE WHEN p_partkey % 25 = 7 THEN '3' END"}


@query("semantic_key", f"""WITH e AS (SELECT p_partkey, p_size, trim(regexp_replace(lower({NAMES}[CAST(p_partkey % {len(NAMES)} AS INT) + 1]), '\\s+', ' ', 'g')) AS n, {_ELEMENT['role']} AS role, {_ELEMENT['editable']} AS editable, {_ELEMENT['value_now']} AS value_now FROM part),
    k AS (SELECT * FROM (VALUES {_values(N.ELEMENT_KEYS.items())}) t(n, key))
    SELECT p_partkey, CASE WHEN coalesce(editable, false) OR coalesce(role = 'textbox', false) THEN 'script_editor' WHEN role = 'tab' AND e.n IN {N.FORMATS} THEN 'format_' || e.n WHEN role = 'slider' OR value_now IS NOT NULL THEN 'slider_unresolved' WHEN starts_with(e.n, 'đăng nhập') OR e.n IN ('login', 'sign in') THEN 'login' ELSE key END AS semantic_key,
      CASE WHEN p_size IS NULL THEN 'missing' WHEN p_size > 40 THEN 'over_limit' WHEN p_size > 30 THEN 'near_limit' ELSE 'ok' END AS input_state FROM e LEFT JOIN k ON k.n = e.n""")
def semantic_key(spark: SparkSession, sf: str) -> DataFrame:
    """What an element is, by its name, role and state, and whether its input is near its limit."""
    size = F.col("p_size")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    key = N.element_key(name, F.expr(_ELEMENT["role"]), F.expr(_ELEMENT["editable"]), F.expr(_ELEMENT["value_now"]))
    return table(spark, sf, "part").select("p_partkey", key.alias("semantic_key"), F.when(size.isNull(), "missing").when(size > 40, "over_limit").when(size > 30, "near_limit").otherwise("ok").alias("input_state"))


@query("session_bootstrap", """WITH s AS (SELECT user_id, bool_or(event_type = 'signup' AND value > 20) AS ok, bool_or(event_type = 'error' AND value > 50) AS denied, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id)
    SELECT user_id, kinds, CASE WHEN denied AND ok THEN 'RECOVERED' WHEN denied THEN 'DENIED' WHEN ok THEN 'READY' ELSE 'NOT_SEEN' END AS state, denied AND NOT ok AS retry FROM s""")
def session_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """A state from the list of a session's statuses, and whether a reload is worth trying."""
    e = F.col("event_type")
    s = table(spark, sf, "events").groupBy("user_id").agg(F.bool_or((e == "signup") & (F.col("value") > 20)).alias("ok"), F.bool_or((e == "error") & (F.col("value") > 50)).alias("denied"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))
    ok, denied = F.col("ok"), F.col("denied")
    return s.select("user_id", "kinds", F.when(denied & ok, "RECOVERED").when(denied, "DENIED").when(ok, "READY").otherwise("NOT_SEEN").alias("state"), (denied & ~ok).alias("retry"))


@query("admission_gate", """WITH u AS (SELECT user_id, list(value ORDER BY ts, event_id) AS samples, max(ts) AS seen FROM events GROUP BY user_id),
    g AS (SELECT user_id, concat_ws(',', CASE WHEN len(samples) < 5 THEN 'too_few_samples' END, CASE WHEN list_min(samples) < 0.5 THEN 'memory_floor' END, CASE WHEN list_bool_or(list_transform(samples, lambda x: x > 110)) THEN 'implausible' END, CASE WHEN NOT (date_diff('second', seen, TIMESTAMP '2024-01-31 00:00:00') BETWEEN -5 AND 86400) THEN 'stale' END) AS reasons FROM u)
    SELECT user_id, reasons, reasons = '' AS admitted FROM g""".replace("list_bool_or(list_transform(samples, lambda x: x > 110))", "len(list_filter(samples, lambda x: x > 110)) > 0"))
def admission_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Least of all samples, plausibility and age of a snapshot, as reasons."""
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.max("ts").alias("seen"))
    age = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "seen"))
    why = R.reasons({"too_few_samples": F.col("n") < 5, "memory_floor": F.col("least") < 0.5, "implausible": F.col("most") > 110, "stale": ~age.between(-5, 86400)})
    return u.select("user_id", F.array_join(why, ",").alias("reasons")).withColumn("admitted", F.col("reasons") == "")


@query("sequence_dry_run", """WITH o AS (SELECT o_orderkey, o_totalprice > 20000 AS render_ok, o_custkey % 5 <> 0 AS asr_ok FROM orders)
    SELECT o_orderkey, CASE WHEN NOT render_ok THEN 'HALT_RENDER' WHEN NOT asr_ok THEN 'HALT_ASR' ELSE 'COMPLETE' END AS outcome, CAST(CASE WHEN NOT render_ok THEN 0 WHEN NOT asr_ok THEN 1 ELSE 2 END AS INT) AS phases FROM o""")
def sequence_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two phases; the first that isn't admitted halts the run."""
    failed = R.first_failing({"HALT_RENDER": F.col("o_totalprice") <= 20000, "HALT_ASR": F.col("o_custkey") % 5 == 0})
    phases = F.when(failed == "HALT_RENDER", 0).when(failed == "HALT_ASR", 1).otherwise(2)
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(failed, F.lit("COMPLETE")).alias("outcome"), phases.alias("phases"))


# Measures of a chunk, made up from a line item.
OBSERVED = {
    "chunk_id": "CASE WHEN l_partkey % 97 = 0 THEN ' ' ELSE concat('c', CAST(l_linenumber AS VARCHAR(9))) END",
    "audio_sha256": "CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE repeat('a', CAST(64 - CASE WHEN l_suppkey % 50 = 7 THEN 1 ELSE 0 END AS INT)) END",
    "attempt": "l_linenumber - CASE WHEN l_partkey % 89 = 0 THEN 7 ELSE 0 END",
    "asr_similarity": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 0.6 + l_discount * 4.4 END",
    "min_word_confidence": "0.4 + l_tax * 7.7",
    "mean_word_confidence": "l_discount * 10.4 - 0.01",
    "pause_ratio": "l_discount * 4",
    "clipping_ratio": "l_tax - 0.001",
    "speaking_rate_wpm": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * 4 - 8 END",
    "pitch_variation_semitones": "l_tax * 90 - 0.5",
}


@query("constraint_report", f"WITH o AS (SELECT {_KEY}, {', '.join(f'{e} AS {k}' for k, e in OBSERVED.items())} FROM lineitem), r AS (SELECT *, {C.violated_sql(C.OBSERVATION)} AS violated FROM o) SELECT {_KEY}, violated FROM r WHERE violated <> ''")
def constraint_report(spark: SparkSession, sf: str) -> DataFrame:
    """Records that break a rule of their contract, and which."""
    o = table(spark, sf, "lineitem").select(*KEY, *(F.expr(e).alias(k) for k, e in OBSERVED.items()))
    return o.select(*KEY, F.array_join(C.violated(C.OBSERVATION), ",").alias("violated")).where("violated <> ''")


@query("lexicon_dup_check", "SELECT lower(p_name) AS source, p_brand, CAST(count(*) AS BIGINT) AS n, min(p_partkey) AS first_key FROM part GROUP BY lower(p_name), p_brand HAVING count(*) > 1")
def lexicon_dup_check(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").groupBy(F.lower("p_name").alias("source"), "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))
    return g.where("n > 1")


#: Profiles in the order that settles ties.
PROFILES = ["BUSINESS_CLEAR", "STORY_NARRATIVE", "GENERAL_CLEAR"]
_PLAIN_SQL = lambda c: f"trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query("style_alias_vote", f"""WITH w AS (SELECT item_id, string_split({_PLAIN_SQL('text')}, ' ') AS w FROM benchmark), g AS (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
    a AS (SELECT DISTINCT {PROFILES}[CAST((item_id + i) % 3 AS INT) + 1] AS profile, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS alias FROM g),
    d AS (SELECT doc_id, {_PLAIN_SQL('text')} AS t, CASE lang WHEN 'de' THEN ['UNKNOWN', 'BUSINESS_CLEAR'] WHEN 'fr' THEN ['STORY_NARRATIVE'] END AS rec FROM documents),
    v AS (SELECT doc_id, profile, count(*) AS n, string_agg(alias, ',' ORDER BY alias) AS names FROM d JOIN a ON contains(t, alias) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, list_position({PROFILES}, profile)) AS r FROM v)
    SELECT d.doc_id, coalesce(profile, rec[len(rec)], 'GENERAL_CLEAR') AS profile, CASE WHEN profile IS NOT NULL THEN 'owner_request' WHEN rec IS NOT NULL THEN 'book_profile' ELSE 'default' END AS source,
      CAST(coalesce(n, 0) AS BIGINT) AS votes, sha256(coalesce(names, '')) AS aliases_sha FROM d LEFT JOIN b ON d.doc_id = b.doc_id AND r = 1""")
def style_alias_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The profile most of whose aliases stand in a text: a table of aliases (here thousands, of three words each) joined by an index of
    its rarest grams, with ties, the book's own profile and the default."""
    words = F.split(X.plain(X.casefold(F.col("text"))), " ")
    b = table(spark, sf, "benchmark").select("item_id", words.alias("w"))
    pair = F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i < F.size("w") - 1), lambda i: F.struct(F.element_at(F.array(*map(F.lit, PROFILES)), ((F.col("item_id") + i) % 3 + 1).cast("int")).alias("profile"), F.concat_ws(" ", F.slice("w", i, F.lit(3))).alias("alias")))
    aliases = b.select(F.explode(pair).alias("x")).select("x.*").distinct()
    rec = F.when(F.col("lang") == "de", F.array(F.lit("UNKNOWN"), F.lit("BUSINESS_CLEAR"))).when(F.col("lang") == "fr", F.array(F.lit("STORY_NARRATIVE")))
    d = table(spark, sf, "documents").select("doc_id", "text", rec.alias("rec"))
    out = terms.resolve_styles(d, "doc_id", "text", aliases, PROFILES, "rec")
    return out.select("doc_id", "profile", "source", "votes", F.sha2(F.array_join("aliases", ","), 256).alias("aliases_sha"))


@query("profile_choice", "WITH c AS (SELECT c_custkey, [c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'BUILDING' END, 'MACHINERY'] AS rec FROM customer) SELECT c_custkey, coalesce(list_extract(list_filter(rec, lambda x: x IN ('BUILDING', 'AUTOMOBILE')), 1), 'GENERAL') AS profile FROM c")
def profile_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The first recommended key that is known, else the default."""
    rec = F.array(F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, "BUILDING"), F.lit("MACHINERY"))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.get(F.filter(rec, lambda x: x.isin("BUILDING", "AUTOMOBILE")), F.lit(0)), F.lit("GENERAL")).alias("profile"))


@query("acceptance_match", "SELECT d.doc_id, sha256(d.lang || '|' || d.source) AS fingerprint, sha256(d.lang || '|' || d.source) = sha256(d.lang || '|' || (CASE WHEN quality = 1 THEN d.source ELSE 'x' END)) AS valid FROM documents d JOIN labels l USING (doc_id)")
def acceptance_match(spark: SparkSession, sf: str) -> DataFrame:
    """An acceptance holds for the fingerprint it was given for."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    now = F.sha2(F.concat_ws("|", "lang", "source"), 256)
    then = F.sha2(F.concat_ws("|", F.col("lang"), F.when(F.col("quality") == 1, F.col("source")).otherwise("x")), 256)
    return d.select("doc_id", now.alias("fingerprint"), (now == then).alias("valid"))


REQUEST = {
    "authenticated": "CASE WHEN o_custkey % 43 = 0 THEN NULL ELSE o_custkey % 41 <> 0 END",
    "n_unknown_fields": "CASE WHEN o_custkey % 37 = 5 THEN 1 ELSE 0 END",
    "n_missing_fields": "CASE WHEN o_custkey % 37 = 6 THEN 2 ELSE 0 END",
    "schema": "CASE WHEN o_custkey % 31 = 0 THEN 'v2' ELSE 'v1' END",
    "task": "'T1'",
    "target": "'library'",
    "action": "CASE WHEN o_orderstatus = 'P' THEN 'write' ELSE 'inventory_readonly' END",
    "root_key": "CASE o_custkey % 19 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE 'MAIN_ROOT' END",
    "scope": "CASE o_custkey % 5 WHEN 0 THEN 'audio' WHEN 1 THEN 'narrator' WHEN 2 THEN 'checkpoint' WHEN 3 THEN 'model' ELSE CASE WHEN o_orderkey % 6 = 0 THEN 'disk' ELSE 'audio' END END",
    "mode": "CASE WHEN o_orderkey % 2 = 0 THEN 'metadata' ELSE 'hash' END",
    "hash_offset": "CASE WHEN o_orderkey % 9 = 0 THEN 5001 WHEN o_orderkey % 3 = 0 THEN o_custkey % 100 ELSE 0 END",
    "metadata_sha": "CASE WHEN o_custkey % 7 = 0 THEN repeat('g', 64) WHEN o_custkey % 3 = 0 THEN repeat('0', 64) END",
    "main_sha": "CASE WHEN o_custkey % 23 = 3 THEN repeat('A', 40) ELSE repeat('a', 40) END",
    "sot_verified": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE true END",
}


@query("request_validation", f"WITH r AS (SELECT o_orderkey, {', '.join(f'{e} AS {k}' for k, e in REQUEST.items())} FROM orders) SELECT o_orderkey, {C.refused_sql(C.READ_REQUEST)} AS rejected FROM r")
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The first of eleven reasons to refuse a request."""
    r = table(spark, sf, "orders").select("o_orderkey", *(F.expr(e).alias(k) for k, e in REQUEST.items()))
    return r.select("o_orderkey", C.refused(C.READ_REQUEST).alias("rejected"))


@query("ci_gate", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id) SELECT user_id, CAST(CASE WHEN last_type = 'error' THEN 3 WHEN last_value < 2 THEN 2 WHEN last_type = 'view' THEN 1 ELSE 0 END AS INT) AS exit_code FROM l")
def ci_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The latest report decides, in stages."""
    at = F.struct("ts", "event_id")
    latest = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", at).alias("t"), F.max_by("value", at).alias("v"))
    return latest.select("user_id", F.when(F.col("t") == "error", 3).when(F.col("v") < 2, 2).when(F.col("t") == "view", 1).otherwise(0).alias("exit_code"))


@query("option_filter", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t FROM pages)
    SELECT DISTINCT page_id, t AS label FROM a WHERE t NOT IN ('The', 'and', 'to') AND NOT regexp_matches(t, '^[0-9]+') AND length(t) <= 24 AND trim(t) <> ''""")
def option_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Menu options: no generic labels, counters or long texts, each once."""
    a = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)))).alias("label"))
    return a.where(~F.col("label").isin("The", "and", "to") & ~F.col("label").rlike("^[0-9]+") & (F.length("label") <= 24) & (F.trim("label") != ""))


@query("readiness_all", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS done, bool_and(o_orderstatus = 'F' AND o_totalprice > 0) AS ready FROM orders GROUP BY o_custkey")
def readiness_all(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("jobs"), F.count_if(done).alias("done"), F.bool_and(done & (F.col("o_totalprice") > 0)).alias("ready"))


FIXED_FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("drift_check", f"""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 17 <> 0),
    j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL AS no_a, b.o_orderkey IS NULL AS no_b, concat_ws(',', {', '.join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in FIXED_FIELDS)}) AS d FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
    SELECT o_orderkey, CASE WHEN no_a THEN 'MISSING_BEFORE' WHEN no_b THEN 'MISSING_AFTER' WHEN d <> '' THEN 'CHANGED' ELSE 'SAME' END AS status, CASE WHEN no_a OR no_b THEN '' ELSE d END AS drifted FROM j""")
def drift_check(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots must agree on every fixed field."""
    o = table(spark, sf, "orders")
    later = o.where("o_orderkey % 17 <> 0").withColumns({"o_orderpriority": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")), "o_totalprice": F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    d = C.drift(o.where("o_orderkey % 11 <> 0"), later, ["o_orderkey"], FIXED_FIELDS)
    return d.select("o_orderkey", "status", F.array_join("drifted", ",").alias("drifted"))


# Cases are conversations, chunks their turns; measures are made up.
CASE_FACTS = {"expected_chunks": "n + CASE WHEN conv_id % 13 = 0 THEN 1 ELSE 0 END", "expected_profile": "concat('P', CAST(conv_id % 3 AS VARCHAR(9)))", "profile": "concat('P', CAST((conv_id + CASE WHEN conv_id % 17 = 1 THEN 1 ELSE 0 END) % 3 AS VARCHAR(9)))", "fingerprint": "CASE WHEN conv_id % 19 = 2 THEN '' ELSE 'f' END"}
CHUNK_FACTS = {
    "technical_error": "CASE WHEN conv_id % 23 = 3 AND turn = 1 THEN 'clipped' END",
    "audio_sha256": "CASE WHEN conv_id % 29 = 4 AND turn = 0 THEN 'none' ELSE repeat('a', 64) END",
    "profile": "concat('P', CAST((conv_id + CASE WHEN conv_id % 31 = 5 AND turn = 0 THEN 1 ELSE 0 END) % 3 AS VARCHAR(9)))",
    "speaking_rate_wpm": "CASE WHEN conv_id % 11 = 6 AND turn = 1 THEN NULL ELSE 120.0 END",
    "pause_ratio": "0.1",
    "pitch_variation_semitones": "1.0",
    "energy_variation_db": "2.0",
    "n_unclear": "CASE WHEN length(text) % 9 = 0 THEN 1 ELSE 0 END",
    "min_word_confidence": "CASE WHEN length(text) % 7 = 0 THEN NULL ELSE 0.5 + (length(text) % 50) * 0.01 END",
    "n_prosody": "length(text) % 4 - 1",
    "warnings": "CASE WHEN length(text) < 60 THEN 1 ELSE 0 END",
    "errors": "CASE WHEN length(text) < 20 THEN 1 ELSE 0 END",
}


@query("case_acceptance", f"""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, {', '.join(f'{x} AS {k}' for k, x in CASE_FACTS.items())} FROM n), c AS (SELECT conv_id, {', '.join(f'{x} AS {k}' for k, x in CHUNK_FACTS.items())} FROM conversations),
    f AS (SELECT e.*, count(*) AS n_chunks, count(*) FILTER (technical_error <> '') AS n_technical, count(*) FILTER (NOT regexp_matches(audio_sha256, '^[0-9a-fA-F]{{64}}$')) AS n_bad_hash, count(*) FILTER (c.profile <> e.expected_profile) AS n_other_profile, count(*) FILTER (speaking_rate_wpm IS NULL) AS n_incomplete,
      count(*) FILTER (n_unclear > 0 OR coalesce(min_word_confidence < 0.68, false)) AS pronunciation_defects, count(*) FILTER (n_prosody > 0) AS prosody_defects, sum(warnings) AS warnings, sum(errors) AS errors FROM e JOIN c USING (conv_id) GROUP BY ALL),
    r AS (SELECT *, {C.refused_sql(C.CASE)} AS refused FROM f)
    SELECT conv_id, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(pronunciation_defects AS BIGINT) AS pronunciation_defects, CAST(prosody_defects AS BIGINT) AS prosody_defects, CAST(warnings AS BIGINT) AS warnings, CAST(errors AS BIGINT) AS errors, refused,
      CASE WHEN refused IS NOT NULL THEN 'REFUSED' WHEN warnings + errors > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM r""")
def case_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """Count, profile, hashes and complete measures of a case, with its localized defects."""
    c = table(spark, sf, "conversations")
    facts = lambda df, of: df.select("conv_id", *(F.expr(e).alias(k) for k, e in of.items()))
    return C.cases(facts(c.groupBy("conv_id").agg(F.count("*").alias("n")), CASE_FACTS), facts(c, CHUNK_FACTS), "conv_id")


@query("process_class", "SELECT event_id, CASE WHEN regexp_matches(event_type, '^(error|signup)$') THEN 'heavy' WHEN regexp_matches(event_type, 'click|view') THEN 'light' ELSE 'other' END AS process_class, list_extract(['SKIPPED', 'OK', 'RETRY'], CAST(event_id % 3 AS INT) + 1) AS run_status FROM events")
def process_class(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type").rlike("^(error|signup)$"), "heavy").when(F.col("event_type").rlike("click|view"), "light").otherwise("other")
    status = F.element_at(F.create_map(F.lit(0), F.lit("SKIPPED"), F.lit(1), F.lit("OK"), F.lit(2), F.lit("RETRY")), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", kind.alias("process_class"), status.alias("run_status"))
