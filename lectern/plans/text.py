"""Queries on text columns: normal forms, extraction, redaction, tokens, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .registry import query, table

_NORMAL = r"""
    WITH a AS (SELECT doc_id, text, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents),
    b AS (SELECT doc_id, text, array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), chr(10)) AS t FROM a),
    c AS (SELECT doc_id, text, regexp_replace(t, '\s+([,.;:!?])', '\1', 'g') AS t FROM b),
    d AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, '([,.;:!?])', '\1' || chr(31), 'g'), chr(31) || '(\s)', '\1', 'g') AS t FROM c),
    e AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, chr(31) || '$', ''), chr(31), ' ', 'g') AS t FROM d),
    n AS (SELECT doc_id, text, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS t FROM e)
"""
_SPOKEN = r"""
    , p AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') AS ps FROM n),
    s AS (SELECT *, array_to_string(list_transform(ps, lambda x: CASE WHEN contains('.!?…:;"''”’', right(x, 1)) THEN x ELSE x || '.' END), chr(10)) AS sp FROM p)
"""


@query("text_normalize", _NORMAL + "SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS normal_sha FROM n")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("normal_sha"))


@query("text_normalize_nfc", _NORMAL.replace("FROM documents", "FROM (SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS text FROM documents)") + "SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS normal_sha FROM n")
def text_normalize_nfc(spark: SparkSession, sf: str) -> DataFrame:
    """As `text_normalize`, for texts whose accents may stand alone; those of ASCII alone are in that form already."""
    apart = F.replace("text", F.lit("é"), F.lit("e\u0301"))
    d = table(spark, sf, "documents").select("doc_id", apart.alias("text"))
    whole = F.when(F.col("text").rlike(r"[^\x00-\x7F]"), X.nfc(F.col("text"))).otherwise(F.col("text"))
    d = d.select("doc_id", X.normalize(whole).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("normal_sha"))


@query("text_spoken_render", _NORMAL + _SPOKEN + "SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_paragraphs, sha256(sp) AS spoken_sha FROM s")
def text_spoken_render(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of these documents are single lines."""
    d = table(spark, sf, "documents").select("doc_id", X.spoken(X.normalize(F.col("text")), "\n").alias("s"))
    return d.select("doc_id", F.when(F.col("s") == "", 0).otherwise(F.size(F.split("s", "\n"))).cast("long").alias("n_paragraphs"), F.sha2("s", 256).alias("spoken_sha"))


@query("text_layers_hash", _NORMAL + _SPOKEN + "SELECT doc_id, sha256(text) AS source_sha, sha256(t) AS normal_sha, sha256(sp) AS spoken_sha, sha256(concat_ws('|', sha256(text), sha256(t), sha256(sp))) AS fingerprint FROM s")
def text_layers_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", X.normalize(F.col("text")).alias("n"))
    d = d.select("doc_id", F.sha2("text", 256).alias("source_sha"), F.sha2("n", 256).alias("normal_sha"), F.sha2(X.spoken(F.col("n"), "\n"), 256).alias("spoken_sha"))
    return d.withColumn("fingerprint", F.sha2(F.concat_ws("|", "source_sha", "normal_sha", "spoken_sha"), 256))


@query("redact_secrets", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\s+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'), 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[jwt]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g')) AS clean_sha FROM documents""")
def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("clean_sha"))


@query("redact_secrets_whole", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\s+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'), 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[jwt]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g')) AS clean_sha FROM documents""")
def redact_secrets_whole(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("clean_sha"))


@query("safe_text_trunc", r"SELECT doc_id, nullif(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120), '') AS safe_text FROM documents")
def safe_text_trunc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.bounded(F.col("text"), 120).alias("safe_text"))


@query("redact_urls", r"""SELECT page_id, sha256(regexp_replace(html, '(https?://[^\s"''?#<>]+)[^\s"''<>]*', '\1', 'g')) AS html_sha FROM pages""")
def redact_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(X.bare_urls(F.col("html")), 256).alias("html_sha"))


@query("url_parts", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare_url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]*)$', 1), '[\\x00-\\x1f:*?\"<>|]', '_', 'g') AS file_name FROM pages")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.bare_url(u).alias("bare_url"), X.url_path(u).alias("path"), X.file_name(X.bare_url(u)).alias("file_name"))


@query("label_norm", r"""SELECT page_id, replace(lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'))), 'ß', 'ss') AS label,
    trim(regexp_replace(replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS plain FROM pages""")
def label_norm(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return t.select("page_id", X.casefold(X.label(F.col("title"))).alias("label"), X.plain(X.casefold(F.col("title"))).alias("plain"))


@query("first_number", r"SELECT page_id, CAST(nullif(regexp_extract(url, '\b([0-9]{1,15})\b', 1), '') AS BIGINT) AS number FROM pages")
def first_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.first_number(F.col("url")).alias("number"))


@query("parse_counter", r"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, printf('%d.%03d / 1,000,000', CAST(l_quantity AS BIGINT), l_partkey % 1000) AS t FROM lineitem),
    p AS (SELECT *, regexp_replace(regexp_extract(t, '([0-9][0-9., ]*)/\s*([0-9][0-9., ]*)', 1), '[^0-9]', '', 'g') AS a, regexp_replace(regexp_extract(t, '([0-9][0-9., ]*)/\s*([0-9][0-9., ]*)', 2), '[^0-9]', '', 'g') AS b FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(nullif(a, '') AS BIGINT) AS used, CAST(nullif(b, '') AS BIGINT) AS allowed FROM p""")
def parse_counter(spark: SparkSession, sf: str) -> DataFrame:
    t = F.format_string("%d.%03d / 1,000,000", F.col("l_quantity").cast("long"), F.col("l_partkey") % 1000)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.counter(t, 1).alias("used"), X.counter(t, 2).alias("allowed"))


@query("display_values", r"""WITH v AS (SELECT event_id, event_type || ': ' || CASE WHEN event_id % 3 = 0 THEN 'on' WHEN event_id % 3 = 1 THEN replace(CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR), '.', ',') ELSE '-' || CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR) END AS t FROM events)
    SELECT event_id, CAST(nullif(replace(regexp_extract(t, '([+-]?[0-9]+(?:[.,][0-9]+)?)', 1), ',', '.'), '') AS DOUBLE) AS number, nullif(regexp_extract(t, '\b(on|off)\b', 1), '') AS state FROM v""")
def display_values(spark: SparkSession, sf: str) -> DataFrame:
    """A label's value: a signed decimal with comma or dot, or a state word."""
    amount = F.col("value").cast("decimal(12,2)").cast("string")
    shown = F.when(F.col("event_id") % 3 == 0, F.lit("on")).when(F.col("event_id") % 3 == 1, F.replace(amount, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit("-"), amount))
    t = F.concat_ws(": ", "event_type", shown)
    number = F.nullif(F.replace(F.regexp_extract(t, "([+-]?[0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")), F.lit(""))
    return table(spark, sf, "events").select("event_id", number.cast("double").alias("number"), F.nullif(F.regexp_extract(t, r"\b(on|off)\b", 1), F.lit("")).alias("state"))


@query("pause_values", r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, printf('Dấu chấm • − %d.5s  DẤU PHẨY , - %ds Dấu chấm phẩy ; − 0.%ds Xuống dòng ¶ - %d.25s', CAST(l_quantity AS BIGINT), l_partkey % 400, l_suppkey % 10, l_linenumber) AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(regexp_extract(t, '(?i)Dấu chấm\s*[•.]?\s*[−-]\s*([0-9]+(?:\.[0-9]+)?)s', 1) AS DOUBLE) AS dot_seconds, CAST(regexp_extract(t, '(?i)Dấu phẩy\s*,?\s*[−-]\s*([0-9]+(?:\.[0-9]+)?)s', 1) AS DOUBLE) AS comma_seconds,
      CAST(regexp_extract(t, '(?i)Dấu chấm phẩy\s*;?\s*[−-]\s*([0-9]+(?:\.[0-9]+)?)s', 1) AS DOUBLE) AS semicolon_seconds, CAST(regexp_extract(t, '(?i)Xuống dòng\s*¶?\s*[−-]\s*([0-9]+(?:\.[0-9]+)?)s', 1) AS DOUBLE) AS newline_seconds FROM t""")
def pause_values(spark: SparkSession, sf: str) -> DataFrame:
    """Four labelled numbers of one text; a missing one fails the query."""
    t = F.format_string("Dấu chấm • − %d.5s  DẤU PHẨY , - %ds Dấu chấm phẩy ; − 0.%ds Xuống dòng ¶ - %d.25s", F.col("l_quantity").cast("long"), F.col("l_partkey") % 400, F.col("l_suppkey") % 10, F.col("l_linenumber"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.alias("t"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *(v.alias(k) for k, v in X.pause_values(F.col("t")).items()))


@query("usage_text", r"SELECT page_id, list_extract(regexp_extract_all(html, '(?i)[0-9]+ (?:[a-z]+ )?(?:items|pages|results)'), 1) AS usage, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links FROM pages")
def usage_text(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("(?i)[0-9]+ (?:[a-z]+ )?(?:items|pages|results)"), F.lit(0))
    return table(spark, sf, "pages").select("page_id", F.get(found, F.lit(0)).alias("usage"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"))


@query("token_digest", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+|\p{L}+(?:[-'']\p{L}+)*')) AS BIGINT) AS n_tokens, sha256(array_to_string(regexp_extract_all(text, '[0-9]+|\p{L}+(?:[-'']\p{L}+)*'), '|')) AS tokens_sha FROM documents")
def token_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("ts"))
    return d.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.sha2(F.array_join("ts", "|"), 256).alias("tokens_sha"))


@query("abbrev_scan", r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[0-9]+|\p{L}+(?:[-'']\p{L}+)*'), lambda t: regexp_full_match(t, '[A-Z]{2,6}'))) AS BIGINT) AS n_abbreviations, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents""")
def abbrev_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = F.filter(X.tokens(F.col("text")), lambda t: t.rlike("^[A-Z]{2,6}$"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n_abbreviations"), X.word_count(F.col("text")).alias("n_words"))


@query("sentence_units", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?…\n]+[.!?…]*'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)
    SELECT doc_id, CAST(i AS INT) AS ordinal, printf('editorial_%04d', CAST(i AS BIGINT)) AS unit_id, CAST(length(ss[i]) AS BIGINT) AS n_chars, substring(sha256(ss[i]), 1, 16) AS unit_sha FROM s, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i)""")
def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "s")).withColumn("ordinal", F.col("i") + 1)
    return s.select("doc_id", "ordinal", F.format_string("editorial_%04d", "ordinal").alias("unit_id"), F.length("s").cast("long").alias("n_chars"), X.short_id(F.col("s"), 16).alias("unit_sha"))


@query("clause_split", r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?…\n]+[.!?…]*'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents),
    c AS (SELECT doc_id, CASE WHEN length(s) <= 125 THEN [s] ELSE list_filter(list_transform(regexp_extract_all(s, '[^,;:]+[,;:]*'), lambda x: trim(x)), lambda x: x <> '') END AS cs FROM s)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST(sum(len(cs)) AS BIGINT) AS n_clauses, CAST(max(list_max(list_transform(cs, lambda x: length(x)))) AS BIGINT) AS longest FROM c GROUP BY doc_id""")
def clause_split(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph, sentence, and, for sentences of over 125 characters, clause."""
    s = table(spark, sf, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    clauses = F.filter(F.transform(F.regexp_extract_all("s", F.lit("[^,;:]+[,;:]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    c = s.withColumn("cs", F.when(F.length("s") <= 125, F.array("s")).otherwise(clauses))
    longest = F.array_max(F.transform("cs", F.length))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.size("cs")).cast("long").alias("n_clauses"), F.max(longest).cast("long").alias("longest"))


@query("punctuation_shape", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(t, '|' ORDER BY t)) AS shaped_sha FROM (SELECT doc_id, CASE WHEN length(s) % 3 = 0 THEN regexp_replace(replace(s, '...', '…'), '\.$', '…') WHEN length(s) % 3 = 1 THEN regexp_replace(replace(s, '...', '…'), ',', '…') ELSE replace(s, '...', '…') END AS t FROM s) GROUP BY doc_id""")
def punctuation_shape(spark: SparkSession, sf: str) -> DataFrame:
    """By class: a closing full stop, or the first comma, becomes an ellipsis; three dots do in any."""
    s = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    dots = F.replace("s", F.lit("..."), F.lit("…"))
    comma = F.instr(dots, ",")
    first = F.when(comma > 0, F.concat(F.substring(dots, F.lit(1), comma - 1), F.lit("…"), F.substring(dots, comma + 1, F.length(dots)))).otherwise(dots)
    shaped = F.when(F.length("s") % 3 == 0, F.regexp_replace(dots, r"\.$", "…")).when(F.length("s") % 3 == 1, first).otherwise(dots)
    return s.select("doc_id", shaped.alias("t")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("t")), "|"), 256).alias("shaped_sha"))


@query("integer_words", N.WORDS_SQL)
def integer_words(spark: SparkSession, sf: str) -> DataFrame:
    """Part prices as spoken whole numbers (0 to 999,999)."""
    n = (F.col("p_retailprice") * 7).cast("long") % 1_000_000
    return table(spark, sf, "part").select("p_partkey", n.alias("number"), N.spoken_integer(n).alias("words"))


@query("plan_fingerprint", "SELECT conv_id, substring(sha256(string_agg(turn || ':' || role || ':' || sha256(text), '|' ORDER BY turn)), 1, 24) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def plan_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", F.col("turn").cast("string"), "role", F.sha2("text", 256)).alias("k"))))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(rows.alias("rs"), F.count("*").alias("n"))
    return g.select("conv_id", X.short_id(F.array_join(F.transform("rs", lambda r: r.k), "|"), 24).alias("fingerprint"), "n")


@query("reference_sanitizer", r"SELECT page_id, CASE WHEN length(url) > 60 OR contains(url, '://') AND regexp_matches(url, '(?i)(token|secret|ref=)') THEN NULL ELSE url END AS reference FROM pages")
def reference_sanitizer(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    bad = (F.length(u) > 60) | (u.contains("://") & u.rlike("(?i)(token|secret|ref=)"))
    return table(spark, sf, "pages").select("page_id", F.when(~bad, u).alias("reference"))


@query("git_blob_digest", "SELECT item_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha1(CAST('blob ' || octet_length(encode(text)) AS BLOB) || '\\x00'::BLOB || encode(text)) AS blob_sha1 FROM benchmark")
def git_blob_digest(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-1 of "blob", the length in bytes, a zero byte and the content, which comes in base 64 and in lines."""
    lines = F.regexp_replace(F.base64("text"), "(.{60})", "$1\n")
    content = X.decoded(lines)
    blob = F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0")).cast("binary"), content)
    return table(spark, sf, "benchmark").select("item_id", F.octet_length(content).cast("long").alias("size"), F.sha1(blob).alias("blob_sha1"))


@query("page_signals", r"""WITH t AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS v, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS ls, regexp_extract_all(html, '<button[^>]*>([^<]*)</button>', 1) AS bs FROM pages)
    SELECT page_id, url, substring(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), 1, 300) AS title, sha256(substring(v, 1, 6000)) AS visible_sha, regexp_matches(html, '<input[^>]*type="password"') AS has_password, regexp_matches(html, '<textarea') AS has_textarea, regexp_matches(html, 'contenteditable="true"') AS has_editable,
      CAST(least(len(bs), 100) AS INT) AS n_buttons, array_to_string(list_transform(list_slice(ls, 1, 100), lambda x: substring(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 160)), '|') AS links FROM t""")
def page_signals(spark: SparkSession, sf: str) -> DataFrame:
    """What a page shows: address without its query, title, visible text, inputs, and the texts of its first hundred buttons and links, each
    collapsed and cut."""
    t = table(spark, sf, "pages")
    line = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    visible = line(F.regexp_replace(F.regexp_replace("html", r"<(script|style)[^>]*>[^<]*</", " "), "<[^>]*>", " "))
    first = lambda tag: F.transform(F.slice(F.regexp_extract_all("html", F.lit(tag), F.lit(1)), 1, 100), lambda x: F.substring(line(x), 1, 160))
    return t.select(
        "page_id", X.bare_url(F.col("url")).alias("url"), F.substring(line(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), 1, 300).alias("title"), F.sha2(F.substring(visible, 1, 6000), 256).alias("visible_sha"),
        F.col("html").rlike('<input[^>]*type="password"').alias("has_password"), F.col("html").rlike("<textarea").alias("has_textarea"), F.col("html").rlike('contenteditable="true"').alias("has_editable"),
        F.size(first("<button[^>]*>([^<]*)</button>")).alias("n_buttons"), F.array_join(first("<a [^>]*>([^<]*)</a>"), "|").alias("links"),
    )


@query("element_inventory", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) + 1)) AS pos FROM pages)
    SELECT page_id, CAST(pos AS INT) AS pos, substring(href, 1, 40) AS href, CASE WHEN starts_with(t, 't') THEN NULL ELSE substring(t, 1, 20) END AS label FROM a WHERE pos <= 400""")
def element_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page, fields cut, at most 400 a page; text is withheld for one class."""
    link = F.lit('<a href="([^"]*)">([^<]*)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html", link, F.lit(1)).alias("h"), F.regexp_extract_all("html", link, F.lit(2)).alias("t"))
    a = table(spark, sf, "pages").select("page_id", F.posexplode(pairs).alias("i", "x")).where("i < 400")
    return a.select("page_id", (F.col("i") + 1).alias("pos"), F.substring("x.h", 1, 40).alias("href"), F.when(~F.startswith("x.t", F.lit("t")), F.substring("x.t", 1, 20)).alias("label"))
