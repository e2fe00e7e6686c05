"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import jaccard, langid, ngram_lm, packing, periodic, pieces, quality_bayes, quality_rules, secrets, spelling, substring, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer's file lies; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_register
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_words_kept", F.sha2("clean_text", 256).alias("clean_sha256"))


ORACLES["op1_quality_rules"] = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
    w AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM s, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM w),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(0, 8)) AS k) WHERE n > 1 GROUP BY doc_id),
    l AS (SELECT doc_id, i, own, trim(own, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l
          FROM (SELECT doc_id, unnest(ls) AS own, unnest(range(len(ls))) AS i FROM s)),
    m AS (SELECT doc_id, i, own, l, len(string_split_regex(l, '[\x20\x09-\x0D]+')) AS n FROM l),
    k AS (SELECT doc_id, sum(n) AS n, string_agg(own, chr(10) ORDER BY i) AS t FROM m
          WHERE NOT ((n >= 5 AND NOT regexp_matches(l, '[.!?…。！？]')) OR len(regexp_extract_all(l, '[#*$%&|<>]+')) > 0.34 * n OR len(regexp_extract_all(l || ' ', '!![\x20\x09-\x0D]')) > 0.4 * n
                     OR (n <= 25 AND (regexp_matches(l, '^[^|»›>]{0,60}([|»›>][^|»›>]{0,60}){2,}$') OR regexp_matches(l, '(?i)(licensed under the|released under the|' ||
                       'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|javascript is disabled|javascript is required|creative commons|' ||
                       'general public license|copyright ©|tous droits réservés|conditions d''utilisation|politique de confidentialité|politique de cookies|mentions légales|' ||
                       'sous licence|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|cookie-richtlinie|lizenziert unter|todos los derechos reservados|' ||
                       'términos de uso|condiciones de uso|política de privacidad|política de cookies|aviso legal|bajo la licencia)'))))
          GROUP BY doc_id),
    r AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(s.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(k.n, 0) AS BIGINT) AS line_words_kept, sha256(coalesce(k.t, '')) AS clean_sha256
          FROM s LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r)
    SELECT *, NOT base_failed AND line_words_kept >= 0.5 * n_words AS kept FROM b
"""


@_register
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


@_register
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")


ORACLES["op3_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, true AS payload_ok FROM m
"""


@_register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op4_substring_dedup"] = r"""
    WITH s AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS h FROM s, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS i)),
    r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM w),
    g AS (SELECT DISTINCT doc_id, i + k AS j FROM r, (SELECT unnest(range(0, 20)) AS k) WHERE n > 1),
    a AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id),
    e AS (SELECT s.doc_id, ws, coalesce(js, []) AS js FROM s LEFT JOIN a USING (doc_id)),
    x AS (SELECT doc_id, j, w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM s)),
    k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.j) AS t FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.j WHERE g.j IS NULL GROUP BY x.doc_id)
    SELECT e.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(js) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM e LEFT JOIN k ON e.doc_id = k.doc_id
"""


@_register
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0).drop("query_hash")


ORACLES["op5_topk_search"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 3)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_languages")


@_register
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.segment(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=False).drop("text")


@_register
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their sections by language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality_bayes.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality_bayes.classify(docs, model, "source", "lang", keep_text=False)
    return out.select("doc_id", "p_bad", "p_toxic", F.col("quality_ok").alias("kept"))


@_register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


@_register
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out(F.col("doc_id"), 5)
    model = ngram_lm.train(docs.where(~held))
    return ngram_lm.score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic.repeat_words(F.col("text"), F.col("doc_id")).alias("text"))
    best, line = F.col("best"), lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = periodic.collapse(docs, keep_text=False).withColumn("best", periodic.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


#: The table of CRC-32 for one byte, by its rule, and the checksum of a list of bytes.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {0}), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295)"

ORACLES["op13_periodic_runs"] = rf"""
    WITH {CRC_TABLE},
    s AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                 {CRC.format("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} AS h FROM documents, crc),
    a AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM s),
    b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
    d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM b),
    c AS (SELECT doc_id, w, n, unnest(list_filter(range(1, n // 4 + 1), lambda p: len(list_filter(range((n - 1) // p - 2), lambda j:
              w[1 + j * p] = w[1 + j * p + p] AND w[1 + j * p + p] = w[1 + j * p + 2 * p] AND w[1 + j * p + 2 * p] = w[1 + j * p + 3 * p])) > 0)) AS p FROM d),
    e AS (SELECT doc_id, p, unnest(list_filter(range(n - p), lambda i: w[1 + i] = w[1 + i + p])) AS i FROM c),
    f AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
    u AS (SELECT doc_id, p, min(i) AS s, max(i) + 1 + p AS e FROM f GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
    r AS (SELECT doc_id, s, e, min(p) AS p FROM u GROUP BY doc_id, s, e),
    z AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, l := e - s, p := p), struct_pack(x := -(e - s) / p, s := s, p := p)) AS z,
                 string_agg(concat(s, ',', e - s, ',', p, chr(10)), '' ORDER BY s, p) AS t FROM r GROUP BY doc_id),
    g AS (SELECT DISTINCT doc_id, unnest(range(s + p, e)) AS i FROM r),
    x AS (SELECT doc_id, unnest(w) AS w, unnest(range(n)) AS i FROM d),
    k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i WHERE g.i IS NULL GROUP BY x.doc_id)
    SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(z.z.s AS BIGINT) AS start, CAST(z.z.l AS BIGINT) AS length, CAST(z.z.p AS BIGINT) AS period,
           CAST(1000 * z.z.l // z.z.p AS BIGINT) AS exponent_milli, sha256(coalesce(z.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
    FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


@_register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(spelling.vocabulary(spelling.drop_letters(runs)))


ORACLES["op12_spelling_variants"] = rf"""
    WITH RECURSIVE {CRC_TABLE},
    t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
    o AS (SELECT doc_id, r, count(*) AS n FROM t GROUP BY doc_id, r),
    h AS (SELECT r, n, {CRC.format("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))")} AS h FROM o, crc),
    e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, n FROM h),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    q AS (SELECT word, n, substr(word, 1, i) AS x, substr(word, i + 2) AS y FROM (SELECT word, n, unnest(range(CAST(length(word) AS INT))) AS i FROM v)),
    d AS (SELECT DISTINCT v.word AS short, v.n AS short_n, q.word AS long, q.n AS long_n FROM q JOIN v ON q.x || q.y = v.word),
    p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM q a JOIN q b ON a.x = b.x AND a.y = b.y AND a.word <> b.word
          UNION ALL SELECT short, long, long_n FROM d UNION ALL SELECT long, short, short_n FROM d),
    m AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -other_n, w := other)) AS top FROM p GROUP BY word),
    f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -top.n >= 2 * v.n THEN top.w END AS form, CASE WHEN -top.n >= 2 * v.n THEN -top.n END AS form_n
          FROM v LEFT JOIN m ON m.word = v.word),
    r AS (SELECT word, form AS up, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, f.word, k + 1 FROM r JOIN f ON f.word = r.up)
    SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN r ON r.word = f.word AND r.up IS NULL
"""


@_register
def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = [r.kind for r in secrets.BASE_RULES]

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts, own = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base], of(*base)
    return found.select("doc_id", *counts, F.sha2(secrets.listed(own), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def _sql_rules() -> str:
    rows = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("(?ai)", "(?i)").replace("'", "''")
        rows.append(f"({i}, '{r.kind}', '{pattern}', {r.group}, {r.least})")
    return ", ".join(rows)


ORACLES["op11_secret_scans"] = f"""
    WITH rules(k, kind, p, g, least) AS (VALUES {_sql_rules()}),
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT doc_id, k, kind, least, string_split_regex(t, p) AS parts, regexp_extract_all(t, p, 0) AS ms, CASE WHEN g = 0 THEN regexp_extract_all(t, p, 0) ELSE regexp_extract_all(t, p, 2) END AS gs
          FROM d, rules WHERE regexp_matches(t, p)),
    i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
    s AS (SELECT doc_id, k, kind, list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS a,
                 length(ms[i]) AS n FROM i WHERE length(gs[i]) >= least),
    o AS (SELECT doc_id, k, CAST(a AS BIGINT) AS a, concat(kind, ':', CAST(a AS BIGINT), ':', CAST(a + n AS BIGINT)) AS x FROM s),
    r AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                 string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM o GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
