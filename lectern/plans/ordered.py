"""Queries over ordered rows: turns of a conversation, events of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ordered as O
from ..operators import paging
from .registry import query, table

USER, TIME = ["user_id"], ["ts", "event_id"]
CONV, TURN = ["conv_id"], ["turn"]


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("chunk_timeline", """WITH d AS (SELECT conv_id, turn, CASE WHEN length(text) >= 80 THEN length(text) * 60 ELSE 0 END AS ms FROM conversations)
    SELECT conv_id, turn, CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def chunk_timeline(spark: SparkSession, sf: str) -> DataFrame:
    t = O.timeline(_turns(spark, sf), CONV, TURN, F.length("text") * 60, F.length("text") >= 80)
    return t.select("conv_id", "turn", F.col("start").cast("long").alias("start_ms"), F.col("end").cast("long").alias("end_ms"))


@query("chunk_gap_policy", """WITH d AS (SELECT conv_id, turn, length(text) % 400 AS b, CASE WHEN text LIKE '%?' THEN 650 WHEN text LIKE '%.' THEN 450 ELSE 380 END AS a FROM conversations),
    g AS (SELECT *, lag(a) OVER w AS p, lead(a) OVER w AS n FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CAST(greatest(coalesce(p, b), b) AS BIGINT) AS gap_ms, CAST(CASE WHEN n IS NULL THEN a ELSE 0 END AS BIGINT) AS tail_ms FROM g""")
def chunk_gap_policy(spark: SparkSession, sf: str) -> DataFrame:
    after = F.when(F.col("text").endswith("?"), 650).when(F.col("text").endswith("."), 450).otherwise(380)
    g = O.gaps(_turns(spark, sf), CONV, TURN, F.length("text") % 400, after)
    return g.select("conv_id", "turn", F.col("gap").cast("long").alias("gap_ms"), F.col("tail").cast("long").alias("tail_ms"))


@query("join_gap_events", """WITH v AS (SELECT conv_id, turn, length(text) % 17 / 10.0 AS silence FROM conversations WHERE length(text) >= 80),
    g AS (SELECT *, CASE WHEN turn = 0 THEN 0.0 ELSE coalesce(lag(silence) OVER (PARTITION BY conv_id ORDER BY turn), 0.0) + silence END AS gap FROM v)
    SELECT conv_id, turn, round(CAST(gap AS DOUBLE), 3) AS gap_s, CASE WHEN gap > 1.2 THEN 'error' WHEN gap > 0.65 THEN 'warning' END AS severity FROM g WHERE gap > 0.65""")
def join_gap_events(spark: SparkSession, sf: str) -> DataFrame:
    """Silence of the previous valid chunk and this one's."""
    v = _turns(spark, sf).where(F.length("text") >= 80).select("conv_id", "turn", (F.length("text") % 17 / 10.0).alias("silence"))
    before = F.lag("silence", 1, 0.0).over(W.partitionBy("conv_id").orderBy("turn"))
    g = v.withColumn("gap", F.when(F.col("turn") == 0, 0.0).otherwise(before + F.col("silence")))
    return g.where("gap > 0.65").select("conv_id", "turn", F.round("gap", 3).alias("gap_s"), F.when(F.col("gap") > 1.2, "error").otherwise("warning").alias("severity"))


@query("silence_islands", """WITH f AS (SELECT user_id, ts, event_id, value < 20 AS s FROM events), i AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS g FROM f)
    SELECT user_id, CAST(max(n) AS BIGINT) AS longest, CAST(count(*) AS BIGINT) AS runs FROM (SELECT user_id, g, count(*) AS n FROM i WHERE s GROUP BY user_id, g) GROUP BY user_id""")
def silence_islands(spark: SparkSession, sf: str) -> DataFrame:
    return O.longest_run(_events(spark, sf), USER, TIME, F.col("value") < 20)


@query("trace_changes", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def trace_changes(spark: SparkSession, sf: str) -> DataFrame:
    return O.changes(_events(spark, sf), USER, TIME, F.col("event_type")).select("event_id", "user_id", "event_type")


@query("trace_terminal_state", """WITH e AS (SELECT user_id, arg_min(value, (ts, event_id)) AS v0, arg_max(value, (ts, event_id)) AS v1, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS made, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS alerts FROM events GROUP BY user_id)
    SELECT user_id, made, alerts, CASE WHEN alerts > made + 4 THEN 'ERROR_SIGNAL' WHEN v1 < v0 AND made > 0 THEN 'SUCCESS_SIGNAL' WHEN made > 0 THEN 'PARTIAL' ELSE 'NO_SIGNAL' END AS state FROM e""")
def trace_terminal_state(spark: SparkSession, sf: str) -> DataFrame:
    """First against last of a trace, with what appeared between."""
    order = F.struct("ts", "event_id")
    e = _events(spark, sf).groupBy("user_id").agg(F.min_by("value", order).alias("v0"), F.max_by("value", order).alias("v1"), F.count_if(F.col("event_type") == "purchase").alias("made"), F.count_if(F.col("event_type") == "error").alias("alerts"))
    state = F.when(F.col("alerts") > F.col("made") + 4, "ERROR_SIGNAL").when((F.col("v1") < F.col("v0")) & (F.col("made") > 0), "SUCCESS_SIGNAL").when(F.col("made") > 0, "PARTIAL").otherwise("NO_SIGNAL")
    return e.select("user_id", "made", "alerts", state.alias("state"))


@query("new_alerts", """WITH b AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts < TIMESTAMP '2024-01-10'),
    a AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, min(event_id) AS first_seen FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)
    SELECT user_id, k, first_seen FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.k = a.k)""")
def new_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Keys not in the baseline, with where each was first seen."""
    e = _events(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    cut = F.lit("2024-01-10").cast("timestamp")
    after = e.where(F.col("ts") >= cut).groupBy("user_id", "k").agg(F.min("event_id").alias("first_seen"))
    return after.join(e.where(F.col("ts") < cut).select("user_id", "k").distinct(), ["user_id", "k"], "left_anti")


@query("eta_running_avg", """WITH c AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
    SELECT event_id, user_id, CAST(coalesce(sum(cents) OVER w, 0) * count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) // greatest(count(*) OVER w, 1) AS BIGINT) AS eta_cents FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def eta_running_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Average of the items done times the items left, in whole hundredths."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    done, left = w.rowsBetween(W.unboundedPreceding, -1), F.count("*").over(w.rowsBetween(0, W.unboundedFollowing))
    c = _events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    c = c.withColumns({"s": F.coalesce(F.sum("cents").over(done), F.lit(0)), "n": F.greatest(F.count("*").over(done), F.lit(1)), "k": left})
    return c.select("event_id", "user_id", F.expr("s * k div n").alias("eta_cents"))


@query("page_fill_budget", "SELECT source, doc_id, CAST(ordinal AS INT) AS ordinal, CAST(running AS BIGINT) AS running FROM (SELECT *, row_number() OVER w AS ordinal, sum(n_chars) OVER w AS running FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE ordinal <= 16 AND running <= 30000")
def page_fill_budget(spark: SparkSession, sf: str) -> DataFrame:
    return O.fill_page(table(spark, sf, "documents"), ["source"], ["doc_id"], F.col("n_chars"), 16, 30_000).select("source", "doc_id", "ordinal", F.col("running").cast("long").alias("running"))


@query("page_continuity", """WITH p AS (SELECT source, doc_id // 40 AS page, CAST(count(*) AS BIGINT) AS files FROM documents GROUP BY ALL)
    SELECT source, CAST(page AS BIGINT) AS page, files, CAST(coalesce(sum(files) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, lead(page) OVER (PARTITION BY source ORDER BY page) IS NULL AS final FROM p""")
def page_continuity(spark: SparkSession, sf: str) -> DataFrame:
    """A page starts where those before it end; the last one alone is final."""
    p = table(spark, sf, "documents").groupBy("source", F.expr("doc_id div 40").alias("page")).agg(F.count("*").alias("files"))
    w = W.partitionBy("source").orderBy("page")
    start = F.coalesce(F.sum("files").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return p.select("source", "page", "files", start.alias("start"), F.lead("page").over(w).isNull().alias("final"))


@query("sequence_contiguity", "SELECT conv_id, bool_and(turn = rn) AS contiguous, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations) GROUP BY conv_id")
def sequence_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return _turns(spark, sf).withColumn("ok", F.col("turn") == n).groupBy("conv_id").agg(F.bool_and("ok").alias("contiguous"), F.count("*").alias("n"))


@query("energy_delta", """WITH v AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / 64) AS rms FROM embeddings)
    SELECT vec_id, label, round(abs(20 * log10(rms / lag(rms) OVER (PARTITION BY label ORDER BY vec_id))), 4) AS delta_db FROM v""")
def energy_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Step in level between neighbours, in decibels. Rows are numbered over many tasks and meet the one before by its number, as there
    are few labels."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = paging.numbered(table(spark, sf, "embeddings").select("vec_id", "label", F.sqrt(square / 64).alias("rms")), "label", ["vec_id"])
    before = v.select(F.col("label").alias("_label"), (F.col("rn") + 1).alias("_rn"), F.col("rms").alias("before"))
    both = v.join(before, F.col("label").eqNullSafe(F.col("_label")) & (F.col("rn") == F.col("_rn")), "left")
    return both.select("vec_id", "label", F.round(F.abs(20 * F.log10(F.col("rms") / F.col("before"))), 4).alias("delta_db"))


@query("keyset_page", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_id > 5000) WHERE n <= 20")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """Of each type the page of 20 behind a key."""
    e = _events(spark, sf).where("event_id > 5000")
    return e.withColumn("n", F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))).where("n <= 20").select("event_id", "event_type")


@query("keyset_pages", "SELECT event_id, event_type, CAST((n - 1) // 20 AS BIGINT) AS page, CAST((n - 1) % 20 + 1 AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def keyset_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page of 20 and place in it of every row of each type, numbered over many tasks."""
    e = paging.numbered(_events(spark, sf).select("event_id", "event_type"), "event_type", ["event_id"])
    return e.select("event_id", "event_type", F.expr("rn div 20").alias("page"), (F.col("rn") % 20 + 1).alias("pos"))


@query("log_since_mark", "SELECT user_id, event_id, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) WHERE pos >= 10")
def log_since_mark(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).where("pos >= 10").select("user_id", "event_id", "pos")


@query("greedy_sentence_merge", r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?…\n]+[.!?…]*'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents),
    u AS (SELECT doc_id, unnest(ss) AS t, unnest(range(1, len(ss) + 1)) AS i FROM s),
    f AS (SELECT doc_id, i, t AS pending, CAST(NULL AS VARCHAR) AS done FROM u WHERE i = 1
      UNION ALL SELECT f.doc_id, u.i, CASE WHEN length(pending) < 180 AND length(pending) + 1 + length(t) <= 280 THEN pending || ' ' || t ELSE t END, CASE WHEN length(pending) < 180 AND length(pending) + 1 + length(t) <= 280 THEN NULL ELSE pending END FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
    o AS (SELECT doc_id, i, done AS t FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, 1000000000, arg_max(pending, i) FROM f GROUP BY doc_id)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS unit_sha FROM o""")
def greedy_sentence_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring short sentences of a document as one unit."""
    d = table(spark, sf, "documents").select("doc_id", X.sentences(F.col("text")).alias("parts"))
    d = d.withColumn("ends", O.short_ends(F.transform("parts", lambda s: F.length(s)), 280, 180)).select("doc_id", F.posexplode(O.joined("parts", "ends")).alias("pos", "unit"))
    return d.select("doc_id", "pos", F.length("unit").cast("long").alias("n_chars"), F.sha2("unit", 256).alias("unit_sha"))


@query("path_sort_rank", "SELECT page_id, CAST(row_number() OVER (ORDER BY lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), url, page_id) AS INT) AS rank FROM pages")
def path_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank by case-folded path, then by address and number: numbered within even ranges of all three, shifted by the counts of the ranges
    before, so that neither many rows nor many equal paths go to one task."""
    rows = table(spark, sf, "pages").select("page_id", F.lower(X.url_path(F.col("url"))).alias("k"), "url", F.lit(0).alias("all"))
    return paging.numbered(rows, "all", ["k", "url", "page_id"]).select("page_id", (F.col("rn") + 1).cast("int").alias("rank"))
