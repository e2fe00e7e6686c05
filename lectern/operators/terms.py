"""Terms in texts: which of a table's terms, of any number, stand in which texts.

Up to MOST_SCANNED terms go to every worker, which finds all of them in one pass over a text, by an Aho-Corasick automaton: no text is
shuffled, and the cost doesn't grow with the number of terms.

More terms are found by an inverted index. Every term is known by one of its grams (GRAM characters; shorter terms by themselves): the one that the fewest texts have. Texts are turned
into their grams, of which those that know no term are dropped, joined with the terms by hash, and each pair is then looked at: the
term has to stand in the text as a whole. What is compared grows with the pairs that share a term's rarest gram, not with texts times
terms. Spark splits a gram that many texts have."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import ship, work_dir
from .arrow import chunks

#: Terms, and their characters, that are shipped to every worker.
MOST_SCANNED, MOST_CHARS = 200_000, 4_000_000

GRAM = 5
#: A text meets its candidates in so many parts, by hash, so that no array has them all.
PARTS = 8


def _grams(text: Column, size: int) -> Column:
    """The different substrings of a length, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * size + "))"), F.lit(1)))


def _written(df: DataFrame) -> DataFrame:
    path = work_dir(df.sparkSession, "grams")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hits(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, term): every different term of `terms` that stands in a text, once. `key` is unique in `texts`. Null and empty terms stand
    nowhere, null texts have none. Compared as they are: normalise both sides alike before."""
    t = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    most = t.limit(MOST_SCANNED + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if 0 < most.n <= MOST_SCANNED and most.chars <= MOST_CHARS:
        return _scanned(texts, key, text, [r.term for r in t.collect()], term)
    sizes = [r.n for r in t.select(F.least(F.length("term"), F.lit(GRAM)).alias("n")).distinct().collect()]  # at most GRAM rows
    of = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    grams = of.select("key", F.explode(F.flatten(F.array(*(_grams(F.col("text"), n) for n in sorted(sizes))))).alias("gram")) if sizes else of.select("key", F.lit("").alias("gram")).limit(0)
    own = t.select("term", F.explode(F.flatten(F.array(*(F.when(F.least(F.length("term"), F.lit(GRAM)) == n, _grams(F.col("term"), n)).otherwise(F.array().cast("array<string>")) for n in sorted(sizes) or [GRAM])))).alias("gram"))
    known = _written(grams.join(own.select("gram").distinct(), "gram", "left_semi"))
    often = known.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    pairs = known.join(rarest, "gram").groupBy("key", F.pmod(F.hash("term"), F.lit(PARTS)).alias("part")).agg(F.collect_list("term").alias("terms"))
    found = pairs.join(of, "key").select("key", F.explode(F.filter("terms", lambda x: F.contains("text", x))).alias("term"))
    return found.select(F.col("key").alias(key), F.col("term").alias(term))


@lru_cache(maxsize=2)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _scanned(texts: DataFrame, key: str, text: str, words: list[str], term: str) -> DataFrame:
    own = ship(texts.sparkSession).sparkContext.broadcast(tuple(sorted(words)))
    of = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(own.value)
        for batch in chunks(batches, "text"):
            found = [(i, w) for i, t in enumerate(batch.column("text").to_pylist()) if t for w in {w for _, w in automaton.iter(t)}]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([i for i, _ in found], pa.int64())), pa.array([w for _, w in found], pa.string())], names=["key", "term"])

    found = of.mapInArrow(run, T.StructType([T.StructField("key", of.schema["key"].dataType), T.StructField("term", T.StringType())]))
    return found.select(F.col("key").alias(key), F.col("term").alias(term))


def resolve_styles(requests: DataFrame, key: str, request: str, aliases: DataFrame, profiles: list[str], recommended: str | None = None, default: str = "GENERAL_CLEAR") -> DataFrame:
    """(key, profile, source, votes, aliases): the profile that a request asks for. Of the profiles with an alias (profile, alias) in
    the request that with most aliases, ties by the order of `profiles`: owner_request. Else the request is a profile's name: owner_profile_key.
    Else the first known one of the array `recommended`: book_profile. Else the default. Requests and aliases are compared without case
    and marks; `key` is unique. An alias counts once a profile."""
    plain = lambda c: X.plain(X.casefold(F.col(c)))
    own = requests.select(key, F.col(request).alias("_raw"), plain(request).alias("_plain"), *([F.col(recommended).alias("_recommended")] if recommended else []))
    named = aliases.select("profile", F.col("alias").alias("_alias"), plain("alias").alias("_term")).where("_term <> ''").distinct()
    found = hits(own, key, "_plain", named, "_term").join(named, "_term")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, profiles)), F.col("profile")), F.lit(0))
    votes = found.where(rank > 0).groupBy(key, "profile").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_alias")).alias("names"))
    best = votes.groupBy(key).agg(F.min(F.struct(-F.col("n"), rank.alias("rank"), "profile", "names")).alias("best")).select(F.col(key).alias("_key"), "best")
    direct = F.upper(F.trim("_raw"))
    known = F.get(F.filter("_recommended", lambda p: p.isin(profiles)), 0) if recommended else F.lit(None).cast("string")
    is_direct = direct.isin(profiles)
    # of the requests those alone that are a profile's name go to the join
    asked = own.select(key, F.when(is_direct, F.col("_raw")).alias("_raw"), *(["_recommended"] if recommended else []))
    joined = asked.join(best, F.col(key) == F.col("_key"), "left")
    return joined.select(
        key,
        F.when(F.col("best").isNotNull(), F.col("best.profile")).when(is_direct, direct).when(known.isNotNull(), known).otherwise(default).alias("profile"),
        F.when(F.col("best").isNotNull(), "owner_request").when(is_direct, "owner_profile_key").when(known.isNotNull(), "book_profile").otherwise("default").alias("source"),
        F.coalesce(-F.col("best.col1"), F.lit(0)).cast("long").alias("votes"),
        F.when(F.col("best").isNotNull(), F.col("best.names")).when(is_direct, F.array("_raw")).otherwise(F.array().cast("array<string>")).alias("aliases"),
    )
