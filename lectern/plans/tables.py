"""Queries of joins, aggregates, sets and lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import paging, sets, state
from .registry import query, table

_c = F.count


@query("severity_counts", "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE event_type = 'click' AND value > 50) AS BIGINT) AS warnings, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY user_id")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(e == "error").alias("errors"), F.count_if((e == "click") & (F.col("value") > 50)).alias("warnings"), _c("*").alias("total"))


@query("mode_share", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, event_type)) AS mode, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) > 0.7 AS dominant FROM c GROUP BY user_id")
def mode_share(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(_c("*").alias("n"))
    g = c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("mode"), (F.max("n") / F.sum("n")).alias("s"))
    return g.select("user_id", "mode", F.round("s", 6).alias("share"), (F.col("s") > 0.7).alias("dominant"))


@query("frequency_map", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, string_agg(source || '=' || n, ',' ORDER BY source) AS counts, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang")
def frequency_map(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").groupBy("lang", "source").agg(_c("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("source", F.concat_ws("=", F.col("source"), F.col("n").cast("string")).alias("p"))))
    g = c.groupBy("lang").agg(pairs.alias("ps"), F.sum("n").alias("n"))
    return g.select("lang", F.array_join(F.transform("ps", lambda p: p.p), ",").alias("counts"), "n")


@query("network_summary", "WITH u AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, min(event_id) AS e FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e) AS n FROM u) SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY e) FILTER (WHERE n <= 12) AS first_keys, CAST(count(*) AS BIGINT) AS distinct_keys FROM r GROUP BY user_id")
def network_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct keys and the first twelve as they were seen."""
    u = table(spark, sf, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.min("event_id").alias("e"))
    r = u.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("e")))
    g = r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= 12, F.struct("e", "k")))).alias("ks"), _c("*").alias("distinct_keys"))
    return g.select("user_id", F.array_join(F.transform("ks", lambda x: x.k), ",").alias("first_keys"), "distinct_keys")


@query("ordered_hash_chain", "WITH b AS (SELECT source, doc_id // 1024 AS block, sha256(string_agg(doc_id || ':' || n_chars || ':' || lang, '|' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) SELECT source, sha256(string_agg(h, '|' ORDER BY block)) AS chain FROM b GROUP BY source")
def ordered_hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    """One digest of a source's rows in order: blocks of 1,024 ids are hashed, then their digests, so that a task holds a block's rows,
    and at the end 64 characters for each block."""
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.col("lang"))
    chain = lambda rows, x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[x]), "|"), 256)
    blocks = table(spark, sf, "documents").groupBy("source", F.expr("doc_id div 1024").alias("block")).agg(chain(F.struct("doc_id", row.alias("r")), "r").alias("h"))
    return blocks.groupBy("source").agg(chain(F.struct("block", "h"), "h").alias("chain"))


@query("age_buckets", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 7 DAY) AS BIGINT) AS old_n, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 7 DAY), 0), 2) AS old_total, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def age_buckets(spark: SparkSession, sf: str) -> DataFrame:
    old = F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp") - F.expr("interval 7 days")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(old).alias("old_n"), F.round(F.coalesce(F.sum(F.when(old, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("old_total"), _c("*").alias("n"))


@query("snapshot_age", "WITH s AS (SELECT user_id, date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS age FROM events GROUP BY user_id) SELECT user_id, CAST(age AS BIGINT) AS age_s, age BETWEEN -5 AND 3600 AS fresh FROM s")
def snapshot_age(spark: SparkSession, sf: str) -> DataFrame:
    now = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    s = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("t")).select("user_id", (now - F.unix_timestamp("t")).alias("age_s"))
    return s.withColumn("fresh", F.col("age_s").between(-5, 3600))


@query("strict_timestamp", "WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS t FROM events) SELECT event_id, CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') THEN CAST(epoch(CAST(replace(replace(t, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS BIGINT) ELSE -1 END AS at FROM t")
def strict_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """Only the exact UTC form is a time."""
    t = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    good = t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return table(spark, sf, "events").select("event_id", F.when(good, F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))).otherwise(F.lit(-1).cast("long")).alias("at"))


@query("metric_coverage", "WITH m AS (SELECT l_returnflag, CASE WHEN l_partkey % 3 <> 0 THEN 1 END AS a, CASE WHEN l_partkey % 5 <> 0 THEN 1 END AS b FROM lineitem) SELECT l_returnflag, CAST(count(a) AS BIGINT) AS n_rate, CAST(count(b) AS BIGINT) AS n_pitch, CAST(count(*) AS BIGINT) AS n, count(b) * 2 >= count(*) AS pitch_half, count(a) * 10 >= count(*) * 7 AS covered FROM m GROUP BY l_returnflag")
def metric_coverage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(_c(F.when(k % 3 != 0, 1)).alias("n_rate"), _c(F.when(k % 5 != 0, 1)).alias("n_pitch"), _c("*").alias("n"))
    return g.withColumns({"pitch_half": F.col("n_pitch") * 2 >= F.col("n"), "covered": F.col("n_rate") * 10 >= F.col("n") * 7})


@query("chapter_totals", "SELECT conv_id, CAST(sum(length(text) * 60) AS BIGINT) AS duration_ms, CAST(min(length(text)) AS BIGINT) AS shortest, CAST(max(length(text)) AS BIGINT) AS longest, round(avg(length(text)), 4) AS mean_chars, sum(length(text) * 60) BETWEEN 30000 AND 200000 AS in_target FROM conversations GROUP BY conv_id")
def chapter_totals(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(n * 60).alias("duration_ms"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 4).alias("mean_chars"))
    return g.withColumn("in_target", F.col("duration_ms").between(30000, 200000))


@query("bag_diff", "WITH b AS (SELECT user_id, event_type, count(*) AS had FROM events WHERE ts < TIMESTAMP '2024-01-12' GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-12') SELECT event_id, user_id, event_type FROM a LEFT JOIN b USING (user_id, event_type) WHERE n > coalesce(had, 0)")
def bag_diff(spark: SparkSession, sf: str) -> DataFrame:
    e, cut = table(spark, sf, "events"), F.lit("2024-01-12").cast("timestamp")
    return sets.bag_difference(e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("set_ops_indices", "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT 'union' AS kind, k FROM (SELECT l_orderkey AS k FROM lineitem UNION SELECT o_orderkey FROM orders) UNION ALL SELECT 'both', k FROM (SELECT l_orderkey AS k FROM lineitem INTERSECT SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders_only', k FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) GROUP BY kind")
def set_ops_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and difference of two key sets by one tagged aggregation instead of three set operations."""
    tagged = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("l"), F.lit(0).alias("o")).unionByName(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("l"), F.lit(1).alias("o")))
    seen = tagged.groupBy("k").agg(F.max("l").alias("l"), F.max("o").alias("o"))
    kinds = F.array_compact(F.array(F.lit("union"), F.when((F.col("l") == 1) & (F.col("o") == 1), "both"), F.when(F.col("l") == 0, "orders_only")))
    return seen.select(F.explode(kinds).alias("kind"), "k").groupBy("kind").agg(_c("*").alias("n"), F.sum("k").alias("total"))


@query("before_after_diff", "WITH b AS (SELECT user_id, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-05' GROUP BY 1), a AS (SELECT user_id, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1) SELECT user_id, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a USING (user_id)")
def before_after_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    day = lambda d: F.lit(d).cast("timestamp")
    top = lambda rows: rows.groupBy("user_id").agg(F.max("value").alias("v"))
    return sets.compare(top(e.where(F.col("ts") < day("2024-01-05"))), top(e.where(F.col("ts") >= day("2024-01-25"))), ["user_id"], "v")


@query("range_envelope_join", "WITH e AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.75) AS hi FROM part GROUP BY p_brand) SELECT p_partkey, p_retailprice BETWEEN lo AND hi AS inside FROM part JOIN e USING (p_brand)")
def range_envelope_join(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    e = paging.quantiles(p, "p_brand", "p_retailprice", {"lo": 0.25, "hi": 0.75})
    return p.join(e, "p_brand").select("p_partkey", F.col("p_retailprice").between(F.col("lo"), F.col("hi")).alias("inside"))


@query("completeness_join", "WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'orphan' WHEN n > 6 THEN 'many' ELSE 'ok' END AS state FROM a FULL JOIN b ON a.k = b.k")
def completeness_join(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("in_a"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(_c("*").alias("n"))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("n").isNull(), "missing").when(F.col("in_a").isNull(), "orphan").when(F.col("n") > 6, "many").otherwise("ok").alias("state"))


@query("override_join", "SELECT d.doc_id, coalesce(CASE WHEN quality = 0 THEN 'override' END, d.lang) AS plan FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_join(spark: SparkSession, sf: str) -> DataFrame:
    over = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit("override").alias("o"))
    return table(spark, sf, "documents").select("doc_id", "lang").join(over, "doc_id", "left").select("doc_id", F.coalesce("o", "lang").alias("plan"))


@query("semi_anti_split", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS queued FROM customer")
def semi_anti_split(spark: SparkSession, sf: str) -> DataFrame:
    """Selected and rejected keys, by a semi and an anti join."""
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("queued", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("queued", F.lit(False)))


@query("positional_zip", "WITH v AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings) SELECT vec_id, CAST(i // 2 AS INT) AS pair, round(CAST(max(CASE WHEN i % 2 = 0 THEN v END) AS DOUBLE), 6) AS audio, round(CAST(max(CASE WHEN i % 2 = 1 THEN v END) AS DOUBLE), 6) AS gap FROM v GROUP BY vec_id, i // 2")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """(audio, gap) pairs of a flat list, in place."""
    at = lambda k: F.round(F.get("embedding", 2 * F.col("pair") + k).cast("double"), 6)
    v = table(spark, sf, "embeddings").withColumn("pair", F.explode(F.sequence(F.lit(0), (F.size("embedding") / 2 - 1).cast("int"))))
    return v.select("vec_id", "pair", at(0).alias("audio"), at(1).alias("gap"))


@query("turn_pairs", f"SELECT a.conv_id, a.turn, levenshtein({X.bare_letters_sql('a.text')}, {X.bare_letters_sql('b.text')}) AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A turn and the next one, compared as a whole as first and second attempt, by their letters without marks."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("next", F.lead(F.struct("turn", "text")).over(w)).where("next.turn = turn + 1")
    return t.select("conv_id", "turn", F.levenshtein(X.bare_letters(F.col("text")), X.bare_letters(F.col("next.text"))).cast("long").alias("distance"))


@query("token_suspects", r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[0-9]+|\p{L}+(?:[-'']\p{L}+)*')) AS ts FROM conversations)
    SELECT a.conv_id, a.turn, array_to_string(list_slice(list_sort(list_filter(a.ts, lambda x: NOT list_contains(b.ts, x))), 1, 24), ',') AS suspects FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def token_suspects(spark: SparkSession, sf: str) -> DataFrame:
    """Expected tokens that the next turn doesn't have, at most 24."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", X.tokens(F.lower("text")).alias("ts"))
    n = t.withColumn("b", F.lead("ts").over(W.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return n.select("conv_id", "turn", F.array_join(F.slice(F.array_sort(F.array_except("ts", "b")), 1, 24), ",").alias("suspects"))


@query("latest_upsert", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("ledger_idempotent", "WITH done AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), open AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT c_custkey, CASE WHEN done.k IS NOT NULL THEN 'reuse' WHEN open.k IS NOT NULL THEN 'blocked' ELSE 'attempt' END AS decision, substring(sha256('op|' || c_custkey), 1, 20) AS op_id FROM customer LEFT JOIN done ON done.k = c_custkey LEFT JOIN open ON open.k = c_custkey")
def ledger_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """A success is reused, an open attempt blocks, anything else is attempted."""
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("done"), F.bool_or(F.col("o_orderstatus") == "P").alias("open"))
    d = F.when(F.col("done"), "reuse").when(F.col("open"), "blocked").otherwise("attempt")
    return table(spark, sf, "customer").select("c_custkey").join(s, "c_custkey", "left").select("c_custkey", d.alias("decision"), X.short_id(F.concat(F.lit("op|"), F.col("c_custkey").cast("string")), 20).alias("op_id"))


@query("journal_consume", "SELECT event_id, user_id, k FROM (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id) AS n FROM events e WHERE ts >= TIMESTAMP '2024-01-08' AND NOT EXISTS (SELECT 1 FROM events j WHERE j.ts < TIMESTAMP '2024-01-08' AND j.user_id = e.user_id AND CAST(json_extract(j.props, '$.k') AS BIGINT) = CAST(json_extract(e.props, '$.k') AS BIGINT))) WHERE n = 1")
def journal_consume(spark: SparkSession, sf: str) -> DataFrame:
    e, cut = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")), F.lit("2024-01-08").cast("timestamp")
    return state.consume_once(e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut), ["user_id", "k"], [F.asc("event_id")]).select("event_id", "user_id", "k")


@query("replace_partition", "WITH new AS (SELECT event_id + 1000000 AS event_id, user_id, 'auto' AS event_type FROM events WHERE event_type = 'error' AND value > 90), t AS (SELECT DISTINCT user_id FROM new) SELECT event_id, user_id, event_type FROM events WHERE NOT (event_type = 'error' AND user_id IN (SELECT user_id FROM t)) UNION ALL SELECT * FROM new")
def replace_partition(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    new = e.where("event_type = 'error' and value > 90").select((F.col("event_id") + 1_000_000).alias("event_id"), "user_id", F.lit("auto").alias("event_type"))
    return state.replace_partition(e.drop("value"), new, ["user_id"], F.col("event_type") == "error")


@query("retry_split", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'idempotent' WHEN o_custkey % 4 >= 2 THEN 'exhausted' ELSE 'queued' END AS decision, CAST(o_custkey % 4 + CASE WHEN o_orderstatus <> 'F' AND o_custkey % 4 < 2 THEN 1 ELSE 0 END AS BIGINT) AS next_attempts FROM orders")
def retry_split(spark: SparkSession, sf: str) -> DataFrame:
    return state.retry_split(table(spark, sf, "orders"), F.col("o_custkey") % 4, F.col("o_orderstatus") == "F", 2).select("o_orderkey", "decision", "next_attempts")


LEGAL = [("", "signup"), ("", "view"), ("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("error", "view")]


@query("illegal_transitions", "WITH s AS (SELECT event_id, user_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS src, event_type AS dst FROM events), l AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEGAL) + ") t(src, dst)) SELECT event_id, user_id, src, dst FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = s.src AND l.dst = s.dst)")
def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    legal = spark.createDataFrame(LEGAL, "src string, dst string")
    return state.illegal_transitions(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", legal).select("event_id", "user_id", "src", "dst")


@query("fifo_claim", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('O', 'P')) WHERE n = 1")
def fifo_claim(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "orders").where("o_orderstatus in ('O', 'P')")
    return state.claim(q, ["o_custkey"], F.col("o_orderstatus") == "P", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("targeted_recheck", """WITH RECURSIVE r AS (SELECT o_orderkey, o_totalprice AS price, 1 AS attempt FROM orders
      UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN price ELSE price * 2 END, attempt + 1 FROM r WHERE price < 50000 AND attempt <= 3)
    SELECT o_orderkey, CAST(attempt AS INT) AS attempt, CASE WHEN price >= 50000 THEN 'PASS' WHEN attempt > 3 THEN 'EXHAUSTED' ELSE 'REPAIR' END AS status FROM r""")
def targeted_recheck(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of check and repair over what the last round changed; the repair helps most orders, and some not at all."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    dearer = lambda rows, attempt: rows.withColumn("price", F.when(F.col("o_orderkey") % 5 == 0, F.col("price")).otherwise(F.col("price") * 2))
    return state.repair_rounds(o, F.col("price") < 50000, dearer, 3).select("o_orderkey", "attempt", "status")


@query("fingerprint_stale", "SELECT p_partkey, sha256(p_brand || '|' || p_type) AS fingerprint, sha256(p_brand || '|' || p_type) IS DISTINCT FROM (CASE WHEN p_size % 4 <> 0 THEN sha256(p_brand || '|' || p_type) END) AS stale FROM part")
def fingerprint_stale(spark: SparkSession, sf: str) -> DataFrame:
    now = F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256)
    return table(spark, sf, "part").select("p_partkey", now.alias("fingerprint"), (~now.eqNullSafe(F.when(F.col("p_size") % 4 != 0, now))).alias("stale"))


@query("json_defaults", "SELECT event_id, CAST(coalesce(json_extract(props, '$.pause'), json_extract(props, '$.k'), '500') AS BIGINT) AS pause, coalesce(json_extract_string(props, '$.kind'), 'NARRATIVE') AS kind FROM events")
def json_defaults(spark: SparkSession, sf: str) -> DataFrame:
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, sf, "events").select("event_id", F.coalesce(get("pause"), get("k"), F.lit("500")).cast("long").alias("pause"), F.coalesce(get("kind"), F.lit("NARRATIVE")).alias("kind"))


@query("json_allow_list", """WITH r AS (SELECT event_id, '{"k": ' || json_extract(props, '$.k') || ', "v": "' || event_type || '", "secret": ' || user_id || '}' AS props FROM events)
    SELECT event_id, concat_ws(',', CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'k=' || json_extract_string(props, '$.k') END, 'v=' || json_extract_string(props, '$.v')) AS accepted, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('k', 'v'))), ',') AS rejected FROM r""")
def json_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    """The allowed keys with their values, and the names of the others."""
    raw = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "v": "'), F.col("event_type"), F.lit('", "secret": '), F.col("user_id"), F.lit("}"))
    m = table(spark, sf, "events").select("event_id", F.from_json(raw, "map<string,string>").alias("m"))
    allowed = lambda k: k.isin("k", "v")
    listed = F.transform(F.array_sort(F.map_entries(F.map_filter("m", lambda k, v: allowed(k)))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("event_id", F.array_join(listed, ",").alias("accepted"), F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda k, v: ~allowed(k)))), ",").alias("rejected"))


@query("map_merge", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'override' ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM orders")
def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Base map overridden by a second one: the second's keys come first and win."""
    base = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    over = F.when(F.col("o_custkey") % 3 == 0, F.create_map(F.lit("priority"), F.lit("override"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
    return table(spark, sf, "orders").select("o_orderkey", merged["priority"].alias("priority"), merged["status"].alias("status"))


@query("distinct_capped", "WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t), f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS words_sha FROM r WHERE n <= 50 GROUP BY doc_id")
def distinct_capped(spark: SparkSession, sf: str) -> DataFrame:
    """First occurrences in order, at most fifty."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(F.slice(F.array_distinct(F.split("text", " ")), 1, 50), " "), 256).alias("words_sha"))


@query("distinct_words", "WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t), f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS words_sha FROM f GROUP BY doc_id")
def distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    """First occurrences in order, all of them."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(F.array_distinct(F.split("text", " ")), " "), 256).alias("words_sha"))


@query("missing_metrics", "SELECT event_id, concat_ws(',', CASE WHEN nullif(event_type, 'error') IS NULL THEN 'event_type' END, CASE WHEN CASE WHEN value > 5 THEN value END IS NULL THEN 'value' END) AS missing FROM events")
def missing_metrics(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"event_type": F.nullif(F.col("event_type"), F.lit("error")), "value": F.when(F.col("value") > 5, F.col("value"))}
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_compact(F.array(*(F.when(v.isNull(), F.lit(k)) for k, v in fields.items()))), ",").alias("missing"))
