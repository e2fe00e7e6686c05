"""The corpus pipeline: quality, language, near duplicates, repeated passages, packing.

In all stages rows stand for themselves: rows that repeat each other are judged alike, and a null id is no id. Columns of `documents`
are passed on; others of the input, too.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of `documents`.
SQL can't express them (a fitted classifier, mixtures, a tokenizer), so ORACLE_SQL is None and tests hold them against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard, langid, packing, quality_bayes, substring
from lectern.llm.queries import tokenizer_path
from lectern.llm.store import materialize
from lectern.session import ship

#: A document needs a main language with this share of its text.
LEAST_LANGUAGE_SHARE = 0.4

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds bad or toxic go. A null text is an empty one; null hosts and paths are sites of their own; rows
    without an id are judged by their text and site, as no label names them."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_bayes.classify(docs, quality_bayes.fit(docs, labels), "source", "lang")
    return judged.where("quality_ok").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts among them, or without a main language, go. Rows without an id teach and are judged like
    others."""
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 3)))
    found = langid.predict(docs, model, "_pred", "_share")
    return found.where((F.col("_pred") != langid.UNKNOWN) & (F.col("_share") >= LEAST_LANGUAGE_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the row that comes first by id and text stays. Rows are told apart by id and text: of
    rows with both in common that with the least other columns stays, while rows with one id and different texts are documents of
    their own. Rows without an id stay."""
    ship(spark)
    found = jaccard.similar(docs)
    gone = found.where("doc_id is not null and not first").select("doc_id", "text_hash").distinct().hint("merge")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    key = [F.col("doc_id").cast("long").alias("_id"), text_hash.alias("_hash")]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    known = docs.where("doc_id is not null").select("*", *key)
    known = known.join(gone, (F.col("_id") == gone["doc_id"]) & (F.col("_hash") == gone["text_hash"]), "left_anti")
    known = known.groupBy("_id", "_hash").agg(F.min(F.struct(*others, "doc_id", "text")).alias("row")).select("row.*").select(docs.columns)
    return known.unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier go from the texts; documents of which no word is left go as a whole."""
    ship(spark)
    cut = substring.remove(docs)
    changed = F.col("kept_text").isNotNull()
    out = cut.where(~changed | (F.col("kept_text") != "")).withColumns({"text": F.coalesce("kept_text", "text"), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))})
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. A null text is an empty one, with its end token; each row is packed, repeated ones and those
    without an id as often as they are there."""
    ship(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
