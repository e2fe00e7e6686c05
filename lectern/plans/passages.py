"""Representative passages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table


@query(
    "passage_topk",
    """
    WITH p AS (SELECT doc_id, CAST(i AS INT) AS pos, trim(list_extract(ps, i)) AS passage
               FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents), LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i)),
    s AS (SELECT *, round(greatest(0.0, 1 - abs(length(passage) - 420) / 420.0)
                          + CASE WHEN contains(passage, '"') THEN 0.5 ELSE 0 END
                          + CASE WHEN regexp_matches(passage, '[0-9]') THEN 0.25 ELSE 0 END
                          + least(0.35, 0.03 * len(regexp_extract_all(passage, '[,;:!?]'))), 6) AS score
          FROM p WHERE passage <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(passage) DESC, pos) AS rn FROM s)
    SELECT doc_id, pos, score, CAST(length(passage) AS BIGINT) AS n_chars, sha256(passage) AS passage_sha FROM r WHERE rn <= 3
    """,
)
def passage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split at newlines, score by length, dialogue, digits and punctuation, and keep three a document."""
    passages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    passages = passages.select("doc_id", (F.col("i") + 1).alias("pos"), F.trim("raw").alias("passage")).where("passage <> ''")
    length = F.length("passage")
    score = (
        F.greatest(F.lit(0.0), 1 - F.abs(length - 420) / 420.0)
        + F.when(F.col("passage").contains('"'), 0.5).otherwise(0.0)
        + F.when(F.col("passage").rlike("[0-9]"), 0.25).otherwise(0.0)
        + F.least(F.lit(0.35), 0.03 * F.regexp_count("passage", F.lit("[,;:!?]")))
    )
    scored = passages.withColumn("score", F.round(score, 6))
    best = W.partitionBy("doc_id").orderBy(F.desc("score"), F.desc(length), "pos")
    top = scored.withColumn("rn", F.row_number().over(best)).where("rn <= 3")
    return top.select("doc_id", "pos", "score", length.cast("long").alias("n_chars"), F.sha2("passage", 256).alias("passage_sha"))
