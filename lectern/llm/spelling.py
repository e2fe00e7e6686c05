"""Spelling variants: words one edit apart, found by bands of their letters' parities.

A word's mask has a bit for each letter, set if the word has the letter an odd number of times. Inserting or deleting a letter flips one bit,
replacing one flips at most two. So of three bands that the bits are dealt into, one at least is equal in two words that are one edit
apart. Words are grouped by (band, its bits, length); a group has the words of that length and those one letter longer. Within a
group the masks are compared (at most two bits differ), then the words (Levenshtein distance 1).

Bits are dealt by how evenly the vocabulary splits on them, so that bands tell about equally much. Masks have some 17 bits of information,
so groups grow with the vocabulary. One of more than LEAF words is dealt again, by what else must be equal: first by half of the
word (the edit is in one half, so the other is the same), then, where that leaves more than LEAF, by three bands of the bits that
aren't shared yet. Groups of the last deal are joined whatever their size. A pair counts where the first of its equal bands, halves
and bands is dealt, and so is found once.

Everything is DataFrame functions: grouped counts and sort-merge joins, which Spark splits where a key is hot. What comes to the
driver is a number for each bit.

Defined results: null texts and words have no part, a null id counts as the empty string, repeated rows count each. An empty table has no words.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import done_with, materialize

#: Words of a group that are compared with each other; larger groups are dealt again.
LEAF = 512
#: a to z have a bit each, all other letters share the rest.
BITS, OWN = 63, 26
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_runs(docs: DataFrame, letters: str = "a-zÀ-ÿ") -> DataFrame:
    """(doc_id, run): every maximal run of letters of the whole texts, A to Z in lower case."""
    lower = F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower())
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"[{letters}]+"), F.lit(0))).alias("run"))


def drop_letters(runs: DataFrame, every: int = 97) -> DataFrame:
    """(word): the runs, of which about one in `every` loses a letter. Which runs and letters depends on crc32(doc_id:run) alone; this
    gives a corpus misspellings that are known."""
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    hashed = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))).alias("h"))
    return hashed.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): how often each word occurs, without short and rare ones."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """A long whose bits are the parities of the word's letter counts."""
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.ascii(F.substring(word, i, F.lit(1))))
    bit = lambda c: F.when(c.between(97, 122), c - 97).otherwise(F.lit(OWN) + c % (BITS - OWN))
    mask = F.aggregate(letters, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))))
    return F.when(F.length(word) > 0, mask).otherwise(F.lit(0).cast("long"))


def _ranked_bits(masks: DataFrame) -> list[int]:
    """Bits in order of how evenly they split the words, the most even first."""
    total, *ones = masks.agg(F.count("*"), *(F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))) for i in range(BITS))).first()
    return sorted(range(BITS), key=lambda i: (abs(2 * (ones[i] or 0) - total), i))


def _bands(ranked: list[int]) -> list[list[int]]:
    return [ranked[k::3] for k in range(3)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _of(table: list[int], *at: Column) -> Column:
    """The entry of a small table by columns that are digits of its number to the base of three."""
    return F.get(F.array(*(F.lit(x) for x in table)), functools.reduce(lambda x, y: x * 3 + y, at))


def near_pairs(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, n_a, b, n_b): every two words of `words` (word, n; each word once) that are one edit apart, once."""
    masks = materialize(words.where("word is not null").select("word", "n", F.length("word").alias("long"), parity_mask(F.col("word")).alias("mask")), "masks")
    ranked = _ranked_bits(masks)
    bands = _bands(ranked)
    first = [_mask(b) for b in bands]
    second = [_mask(b) for band in bands for b in _bands([x for x in ranked if x not in band])]
    half = F.floor(F.col("l") / 2).cast("int")
    rest = F.col("l") - half
    part = F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", F.col("long") - rest + 1, rest))
    deals = [
        ("band", 3, lambda: _of(first, F.col("band")).bitwiseAND(F.col("mask"))),
        ("side", 2, lambda: part),
        ("sub", 3, lambda: _of(second, F.col("band"), F.col("sub")).bitwiseAND(F.col("mask"))),
    ]
    members = masks.withColumn("l", F.explode(F.array(F.col("long"), F.col("long") - 1))).withColumn("g", F.lit(0).cast("long"))
    found, dealt = [], []
    for name, ways, share in deals:
        members = members.withColumn(name, F.explode(F.array(*(F.lit(k) for k in range(ways))))).withColumn("g", F.xxhash64("g", name, "l", share()))
        dealt.append(name)
        last = len(dealt) == len(deals)
        large = materialize(members.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > leaf).select("g"), "large-groups")
        found.append(_compared(members if last else members.join(large, "g", "left_anti"), dealt, first, second))
        if last or large.isEmpty():
            break
        members = materialize(members.join(large, "g", "left_semi"), "large-members")
    out = materialize(functools.reduce(DataFrame.unionByName, found), "spelling-pairs")
    done_with(masks)
    return out


def _compared(members: DataFrame, dealt: list[str], first: list[int], second: list[int]) -> DataFrame:
    """The near pairs within the groups `g`, each where it counts."""
    longer = F.col("long") > F.col("l")
    a = members.where(~longer).select("g", "l", *dealt, F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"))
    b = members.select(F.col("g").alias("g_b"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"), longer.alias("longer"))
    differ = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    conditions = [F.col("g") == F.col("g_b"), F.col("longer") | (F.col("a") < F.col("b")), F.bit_count(differ) <= 2, _first_equal(differ, [F.lit(x) for x in first], F.col("band"))]
    if "sub" in dealt:
        conditions.append(_first_equal(differ, [_of(second, F.col("band"), F.lit(k)) for k in range(3)], F.col("sub")))
    if "side" in dealt:
        half = F.floor(F.col("l") / 2).cast("int")
        conditions.append((F.col("side") == 0) == (F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)))
    conditions.append(F.levenshtein("a", "b", 1) == 1)
    return a.join(b.hint("merge"), functools.reduce(Column.__and__, conditions)).select("a", "n_a", "b", "n_b")


def _first_equal(differ: Column, masks: list[Column], at: Column) -> Column:
    """`at` is the first of the bands in which no bit differs."""
    equal = [differ.bitwiseAND(m) == 0 for m in masks]
    return at == F.when(equal[0], 0).when(equal[1], 1).when(equal[2], 2).otherwise(-1)


def variants(words: DataFrame, ratio: int = 2, leaf: int = LEAF) -> DataFrame:
    """`words` (word, n) with n_near, its number of near words; `form`, that near word of greatest n (of equal ones the first in code-point
    order) if it has at least `ratio` times the word's n; form_n; and `root`, where following forms ends."""
    words = materialize(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words, leaf)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("top"))
    top, top_n = F.col("top")["other"], -F.col("top")["col1"]
    taken = top_n >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, top).alias("form"), F.when(taken, top_n).alias("form_n"))
    judged = materialize(judged, "spelling-forms")
    return judged.join(roots(judged), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. n grows along forms, so there is no cycle; each round doubles how far a word looks, so a
    chain of 60 words takes six."""
    ways = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-ways")
        if further.where("moved").isEmpty():
            return ways
        done_with(ways)
        ways = further.drop("moved")
        ways._written = further._written
