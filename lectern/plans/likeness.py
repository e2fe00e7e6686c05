"""Queries on likeness of texts and dictionary rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..session import ship
from .registry import query, table


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A turn (expected) and the next (heard)."""
    next_ = F.lead(F.struct("turn", "text")).over(W.partitionBy("conv_id").orderBy("turn"))
    rows = ship(spark).read.parquet(f"{sf}/conversations.parquet").withColumn("n", next_).where("n.turn = turn + 1")
    return rows.select("conv_id", "turn", "text", F.col("n.text").alias("heard"))


@query("similarity_ratio")
def similarity_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("conv_id", "turn", F.round(S.matching_ratio(F.lower("text"), F.lower("heard")), 6).alias("ratio"))


@query("mismatch_tokens")
def mismatch_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The first 24 expected tokens that were replaced or left out."""
    found = S.replaced_tokens(X.tokens(F.lower("text")), X.tokens(F.lower("heard")))
    return _pairs(spark, sf).select("conv_id", "turn", F.array_join(F.slice(found, 1, 24), ",").alias("suspects"))


#: Phrases that have to be heard.
MUST_HEAR = ["the and of", "nicht wahr", "Érela qué"]
_WORDS = lambda c: f"list_filter(string_split(trim(regexp_replace({X.bare_letters_sql(c)}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query("phrase_window", f"""WITH p AS (SELECT phrase, {_WORDS('phrase')} AS p FROM (SELECT unnest({MUST_HEAR}) AS phrase)), h AS (SELECT conv_id, turn, {_WORDS('text')} AS w FROM conversations), c AS (SELECT * FROM h, p WHERE len(w) > 0),
    k AS (SELECT *, unnest(range(greatest(len(p) - 1, 1), len(p) + 2)) AS k FROM c), i AS (SELECT *, unnest(range(1, greatest(len(w) - k + 1, 1) + 1)) AS i FROM k),
    s AS (SELECT conv_id, turn, phrase, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x, array_to_string(p, ' ') AS y FROM i),
    b AS (SELECT conv_id, turn, phrase, max(1 - levenshtein(x, y) / greatest(length(x), length(y), 1)) AS best FROM s GROUP BY ALL)
    SELECT h.conv_id, h.turn, p.phrase, round(CAST(coalesce(best, 0) AS DOUBLE), 6) AS best FROM h CROSS JOIN p LEFT JOIN b ON h.conv_id = b.conv_id AND h.turn = b.turn AND p.phrase = b.phrase""")
def phrase_window(spark: SparkSession, sf: str) -> DataFrame:
    """How well each phrase is heard somewhere in a turn: its likeness to runs of words one shorter to one longer, all over the turn. By
    letters without marks, as engines count others differently; by edit distance, which needs no Python."""
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(X.bare_letters(c), r"\s+", " ")), " "), lambda w: w != "")
    c = table(spark, sf, "conversations").select("conv_id", "turn", words(F.col("text")).alias("w"))
    phrases = F.array(*(F.struct(F.lit(p).alias("phrase"), words(F.lit(p)).alias("p")) for p in MUST_HEAR))
    rows = c.select("conv_id", "turn", "w", F.explode(phrases).alias("x")).select("conv_id", "turn", "w", "x.*")
    return rows.select("conv_id", "turn", "phrase", F.round(S.best_window(F.col("w"), F.col("p")), 6).alias("best"))


#: Fixed spoken forms for the query below: none begins with a word that another one ends with.
SPOKEN = {"the": "thee", "and": "ampersand", "of the": "o' the", "in": "inside", "de la": "dela", "und": "and"}


@query("lexicon_rewrite", """WITH a AS (SELECT doc_id, ' ' || replace(text, ' ', '  ') || ' ' AS t FROM documents),
    b AS (SELECT doc_id, replace(replace(t, ' of  the ', ' \x01 '), ' de  la ', ' \x02 ') AS t FROM a),
    c AS (SELECT doc_id, replace(replace(replace(replace(t, ' the ', ' thee '), ' and ', ' \x03 '), ' in ', ' inside '), ' und ', ' and ') AS t FROM b),
    d AS (SELECT doc_id, replace(replace(replace(t, '\x01', 'o''  the'), '\x02', 'dela'), '\x03', 'ampersand') AS t FROM c)
    SELECT doc_id, sha256(replace(substring(t, 2, length(t) - 2), '  ', ' ')) AS spoken_sha FROM d""")
def lexicon_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.rewrite_spans(F.col("text"), SPOKEN), 256).alias("spoken_sha"))
