"""Nested and untrusted records: coercion, scrubbing, search, duplicate keys, typed projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons as J
from ..functions import text as X
from ..session import ship
from .registry import query, table


@query("scalar_or_array", """WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' || (event_id % 9) WHEN 1 THEN '[' || (event_id % 7) || ', ' || (event_id % 5) || ']' WHEN 2 THEN '[]' END AS raw FROM events),
    a AS (SELECT event_id, CASE WHEN raw IS NULL THEN [] WHEN raw LIKE '[%' THEN CAST(raw AS BIGINT[]) ELSE [CAST(raw AS BIGINT)] END AS xs FROM r)
    SELECT event_id, CAST(len(xs) AS INT) AS n, CAST(coalesce(list_sum(xs), 0) AS BIGINT) AS total, coalesce(array_to_string(xs, ','), '') AS items FROM a""")
def scalar_or_array(spark: SparkSession, sf: str) -> DataFrame:
    """A number, an array of numbers or nothing, as an array."""
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN concat('', event_id % 9) WHEN 1 THEN concat('[', event_id % 7, ', ', event_id % 5, ']') WHEN 2 THEN '[]' END")
    none = F.array().cast("array<bigint>")
    xs = F.when(F.col("raw").isNull(), none).when(F.col("raw").startswith("["), F.coalesce(F.from_json("raw", "array<bigint>"), none)).otherwise(F.array(F.col("raw").try_cast("bigint")))
    e = table(spark, sf, "events").select("event_id", raw.alias("raw")).withColumn("xs", xs)
    return e.select("event_id", F.size("xs").alias("n"), F.aggregate("xs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_join("xs", ",").alias("items"))


# Fixed shape of a report: some keys are allowed, at two levels, and at most three items of a list.
_ERROR = "'{\"code\": ' || event_id % 9 || ', \"Message\": \"' || event_type || ' by user' || user_id || '@mail.example.org\", \"cookie\": \"c' || event_id || '\", \"detail\": {\"status\": \"s' || event_id % 3 || '\", \"session\": \"x\", \"inner\": {\"code\": 1, \"deep\": {\"code\": 2}}}, \"items\": [' || event_id % 5 || ', 1, 2, 3, 4]}'"
_ERROR_SCHEMA = "code bigint, Message string, detail struct<status: string, inner: struct<code: bigint>>, items array<bigint>"


@query("json_scrub", f"""WITH r AS (SELECT event_id, {_ERROR} AS raw FROM events)
    SELECT event_id, CAST(json_extract(raw, '$.code') AS BIGINT) AS code, substring(regexp_replace(json_extract_string(raw, '$.Message'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[email]', 'g'), 1, 280) AS message, json_extract_string(raw, '$.detail.status') AS detail_status,
    CAST(json_extract(raw, '$.detail.inner.code') AS BIGINT) AS inner_code, array_to_string(list_slice(CAST(json_extract(raw, '$.items') AS BIGINT[]), 1, 3), ',') AS items FROM r""")
def json_scrub(spark: SparkSession, sf: str) -> DataFrame:
    """The allowed keys of a report alone, two levels deep, lists cut to three, messages redacted and cut: the schema is the list of
    what may pass, so nothing else is ever parsed out."""
    raw = F.expr(_ERROR)
    r = table(spark, sf, "events").select("event_id", F.from_json(raw, _ERROR_SCHEMA).alias("r"))
    return r.select("event_id", "r.code", X.redact(F.col("r.Message"), 280).alias("message"), F.col("r.detail.status").alias("detail_status"), F.col("r.detail.inner.code").alias("inner_code"), F.array_join(F.slice("r.items", 1, 3), ",").alias("items"))


_FIND = """'{"name": "' || event_type || '", "n": ' || user_id || ', "inner": {"name": "v' || event_id % 5 || '", "list": [{"name": "v' || event_id % 7 || '", "n": ' || event_id % 11 || '}, {"name": "w", "n": 3, "deep": [[{"at": {"name": "v' || event_id % 3 || '", "n": ' || event_id % 13 || '}}], 7, "v3"]}]}}'"""


@query("json_find", f"""WITH r AS (SELECT event_id, {_FIND} AS raw FROM events), t AS (SELECT event_id, j.* FROM r, json_tree(raw) j),
    s AS (SELECT event_id, path, string_agg(json_extract_string(atom, '$'), ' ' ORDER BY id) AS s FROM t WHERE type NOT IN ('OBJECT', 'ARRAY') GROUP BY event_id, path)
    SELECT t.event_id, t.fullkey AS path, CAST(length(s) AS INT) AS n_chars FROM t JOIN s ON s.event_id = t.event_id AND s.path = t.fullkey WHERE t.type = 'OBJECT' AND contains(s, 'v3') """)
def json_find(spark: SparkSession, sf: str) -> DataFrame:
    """Every record, at any level, whose own scalar values hold a text; the shape is known to nobody."""
    r = table(spark, sf, "events").select("event_id", F.expr(_FIND).alias("raw"))
    found = J.records_with(r, ["event_id"], "raw", "v3")
    own = F.array_join(F.filter(F.map_values(F.from_json("record", "map<string,string>")), lambda x: ~x.rlike(r"^[\[{]")), " ")
    return found.select("event_id", "path", F.length(own).alias("n_chars"))


_TWICE = """'{"k": ' || user_id || ', "in": {"k": 2, "' || (CASE WHEN event_id % 6 = 0 THEN 'k' ELSE 'v' END) || '": [{"w": "a \\\\"k\\\\": b", "' || (CASE WHEN event_id % 4 = 0 THEN 'w' ELSE 'x' END) || '": 3}, {"w": {"k": 1}}]}, "x": "}"}'"""


@query("json_duplicate_keys", r"""WITH r AS (SELECT event_id, """ + _TWICE.replace("\\\\", "\\") + r""" AS raw FROM events), a AS (SELECT event_id, regexp_extract_all(raw, '"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+') AS ts FROM r),
    t AS (SELECT event_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM a),
    d AS (SELECT *, sum(CASE WHEN t IN ('{', '[') THEN 1 WHEN t IN ('}', ']') THEN -1 ELSE 0 END) OVER w AS depth, lead(t) OVER w AS after FROM t WINDOW w AS (PARTITION BY event_id ORDER BY i)),
    c AS (SELECT *, max(CASE WHEN t IN ('{', '[') THEN i END) OVER (PARTITION BY event_id, depth ORDER BY i) AS container FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_id, container, t ORDER BY i) AS n FROM c WHERE after = ':')
    SELECT event_id, CAST(count(*) FILTER (n > 1) AS INT) AS n_twice, coalesce(string_agg(trim(t, '"'), ',' ORDER BY i) FILTER (n > 1), '') AS twice FROM k GROUP BY event_id""")
def json_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that an object gives twice, at any depth; parsers keep one of the two silently."""
    r = table(spark, sf, "events").select("event_id", J.duplicate_keys(F.expr(_TWICE)).alias("twice"))
    return r.select("event_id", F.size("twice").alias("n_twice"), F.array_join("twice", ",").alias("twice"))


_LOOSE = """'{"z": ' || value || ', "a": {"user": ' || user_id || ', "list": [ ' || event_id || ', 1.50, 1e3, null, {"y": true, "é": "' || event_type || '"}]}, "B": 1e-7}'"""


@query("canonical_digest", f"""SELECT event_id, sha256('{{"B":1e-07,"a":{{"list":[' || event_id || ',1.5,1000.0,null,{{"y":true,"é":"' || event_type || '"}}],"user":' || user_id || '}},"z":' || value || '}}') AS digest FROM events""")
def canonical_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of a record, whatever order, blanks and forms of numbers it came in."""
    return table(ship(spark), sf, "events").select("event_id", J.digest(F.expr(_LOOSE)).alias("digest"))


@query("record_map", """WITH f AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS n_records, max(n) > 1 AS has_duplicates, CAST(max(CASE WHEN l_linenumber = 1 THEN q END) AS DOUBLE) AS first_quantity, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS numbers FROM f GROUP BY l_orderkey""")
def record_map(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an order as a map by their number; a number that comes twice is told, and the least record stands for it."""
    f = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.count("*").alias("n"))
    m = f.groupBy("l_orderkey").agg(F.sum("n").alias("n_records"), (F.max("n") > 1).alias("has_duplicates"), F.map_from_entries(F.collect_list(F.struct("l_linenumber", "q"))).alias("m"))
    return m.select("l_orderkey", "n_records", "has_duplicates", F.try_element_at("m", F.lit(1)).alias("first_quantity"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("numbers"))


_GRANT = """CASE event_id % 5 WHEN 0 THEN '{"id": "p' || user_id || '", "size": ' || event_id || ', "open": true, "secret": "s"}' WHEN 1 THEN '{"id": 7, "size": "many", "open": "yes"}' WHEN 2 THEN '{"id": "' || repeat('x', 90) || '", "size": -4}' WHEN 3 THEN 'no json' ELSE '{"id": "q", "size": 3.5, "open": false}' END"""


@query("typed_projection", f"""WITH r AS (SELECT event_id, {_GRANT} AS raw FROM events), j AS (SELECT event_id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM r),
    t AS (SELECT event_id, CASE WHEN json_type(j, '$.id') = 'VARCHAR' AND length(json_extract_string(j, '$.id')) BETWEEN 1 AND 80 THEN json_extract_string(j, '$.id') END AS id,
      CASE WHEN json_type(j, '$.size') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(j, '$.size') AS BIGINT) BETWEEN 0 AND 1000000000 THEN CAST(json_extract_string(j, '$.size') AS BIGINT) END AS size,
      CASE WHEN json_type(j, '$.open') = 'BOOLEAN' THEN CAST(json_extract_string(j, '$.open') AS BOOLEAN) END AS open FROM j)
    SELECT event_id, id, size, open, id IS NOT NULL AND size IS NOT NULL AND open IS NOT NULL AS whole FROM t""")
def typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The known fields of an untrusted record, each only if of its type and within its range; others are dropped. Types are told by
    the JSON itself, not by what could be cast."""
    raw = F.expr(_GRANT)
    j = table(spark, sf, "events").select("event_id", F.try_parse_json(raw).alias("j"))
    typed = lambda k, t: F.when(F.schema_of_variant(F.try_variant_get("j", f"$.{k}", "variant")) == t, F.try_variant_get("j", f"$.{k}", {"STRING": "string", "BIGINT": "bigint", "BOOLEAN": "boolean"}[t]))
    t = j.select("event_id", typed("id", "STRING").alias("id"), typed("size", "BIGINT").alias("size"), typed("open", "BOOLEAN").alias("open"))
    t = t.withColumns({"id": F.when(F.length("id").between(1, 80), F.col("id")), "size": F.when(F.col("size").between(0, 1_000_000_000), F.col("size"))})
    return t.withColumn("whole", F.col("id").isNotNull() & F.col("size").isNotNull() & F.col("open").isNotNull())
