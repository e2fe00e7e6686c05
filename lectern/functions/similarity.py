"""Likeness of two texts, and rewriting by a dictionary."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters; null where either is null, 1 where both are empty. It depends on the order
    of the two. There is no built-in for it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def replaced_tokens(expected: pd.Series, heard: pd.Series) -> pd.Series:
    """Tokens of the first list that the second replaces or lacks, each once and in order of their place."""

    def one(a: list[str], b: list[str]) -> list[str]:
        a, b = list(a), list(b)
        steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        return list(dict.fromkeys(t for kind, lo, hi, *_ in steps if kind in ("replace", "delete") for t in a[lo:hi]))

    return pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(expected, heard)])


def edit_likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length: another measure than `matching_ratio`, without Python."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def best_window(words: Column, phrase: Column) -> Column:
    """The best `edit_likeness` of a phrase (an array of words) to runs of words one shorter to one longer; 0 without words."""
    target, n = F.array_join(phrase, " "), F.size(phrase)
    widths = F.sequence(F.greatest(n - 1, F.lit(1)), n + 1)

    def at_width(k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
        return F.array_max(F.transform(starts, lambda i: edit_likeness(F.array_join(F.slice(words, i, k), " "), target)))

    return F.when((F.size(words) == 0) | (n == 0), F.lit(0.0)).otherwise(F.array_max(F.transform(widths, at_width)))


def rewrite_spans(text: Column, spoken: dict[str, str]) -> Column:
    """The text with each whole word or phrase of `spoken` replaced by its spoken form. Of overlapping ones the earlier goes first, then
    the longer; a replaced span is not read again. Case counts.

    One pass for the spans and one for what stands between them, by an expression that tries each phrase, the longest first, so for some
    hundred phrases; `spoken.spoken_form` takes as many as there are."""
    if not all(spoken):
        raise ValueError("an empty phrase")
    table = F.create_map(*(F.lit(x) for pair in spoken.items() for x in pair))
    sought = "(?<![^ ])(?:" + "|".join(re.escape(k) for k in sorted(spoken, key=len, reverse=True)) + ")(?![^ ])"
    said = F.transform(F.regexp_extract_all(text, F.lit(sought), F.lit(0)), lambda x: F.element_at(table, x))
    # one piece more than spans: null is passed over behind the last
    return F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(text, sought).alias("kept"), said.alias("said")), lambda x: F.array(x["kept"], x["said"]))), "")
