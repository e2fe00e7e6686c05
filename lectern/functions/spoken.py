"""Spoken forms: the entries of a lexicon in a text, with their places, and the text with each replaced by what is said for it.

All entries are found in one pass over a text, by an Aho-Corasick automaton of their case-folded sources that each worker process builds
once from the broadcast lexicon; the cost doesn't grow with the number of entries. An occurrence counts if it stands as a whole word
(no letter, digit or underscore beside it; unless its entry says otherwise) and, for entries with case, in the entry's own case. Of an
entry's occurrences those count that don't overlap an earlier one. Of overlapping matches the one that starts first stays, of those
the longest, then the one with the smallest key.

Case is folded a character at a time, so that places stay what they were."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.arrow import add_columns
from .numbers import DIGITS

# What an entry can be.
CATEGORIES = ("abbreviation", "unit", "name", "foreign_term", "number", "other")
#: A lexicon of more entries is no dictionary to ship to every worker; `terms.hits` joins term tables of any size.
MOST_ENTRIES = 200_000


@dataclass(frozen=True)
class Entry:
    key: str
    source: str
    spoken: str
    case_sensitive: bool = False
    whole_word: bool = True
    category: str = "other"


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def checked(entries: list[Entry]) -> list[Entry]:
    """The entries, longest source first. An error if one lacks something, is of no known category, or repeats another's key, or its
    source (in NFC, by its case rule) under the same rules."""
    keys, sources = set(), set()
    for e in entries:
        for what in ("key", "source", "spoken"):
            if not getattr(e, what).strip():
                raise ValueError(f"lexicon: an entry has no {what}")
        if e.category not in CATEGORIES:
            raise ValueError(f"lexicon: unsupported category {e.category}")
        source = nfc(e.source)
        own = (source if e.case_sensitive else source.casefold(), e.case_sensitive, e.whole_word)
        if e.key in keys:
            raise ValueError(f"lexicon: repeated key {e.key}")
        if own in sources:
            raise ValueError(f"lexicon: repeated source {e.source}")
        keys.add(e.key), sources.add(own)
    if len(entries) > MOST_ENTRIES:
        raise ValueError("lexicon: too many entries to ship; join them as a table of terms")
    return sorted(entries, key=lambda e: (-len(e.source), e.source))


def load(spark: SparkSession, path: str) -> list[Entry]:
    """The entries of lexicon files: {"entries": [{"key", "source", "spoken", "category", "case_sensitive", "whole_word"}]}. Other
    fields are passed over. Of a folder all files count, together checked as one lexicon."""
    rows = [r for text in spark.read.text(path, wholetext=True).limit(MOST_ENTRIES).collect() for r in json.loads(text.value)["entries"]]
    return checked([Entry(str(r["key"]), str(r["source"]), str(r["spoken"]), bool(r.get("case_sensitive", False)), bool(r.get("whole_word", True)), str(r.get("category", "other"))) for r in rows])


#: Fixed entries for the registered queries: ASCII letters, as engines fold others differently.
LEXICON = checked([Entry("of_the", "of the", "o' the"), Entry("the", "the", "thee"), Entry("in", "In", "inside", True), Entry("and", "and", "ampersand"), Entry("de_la", "de la", "dela"), Entry("und", "UND", "plus")])
SINGLE = checked([Entry("the", "the", "thee"), Entry("and", "and", "ampersand"), Entry("was", "was", "woz"), Entry("in", "In", "inside", True)])

#: Characters that a case-blind match takes for others of one length: the lower case of a character alone, and these.
_ALIKE = {ord("ς"): "σ", ord("ſ"): "s", ord("µ"): "μ"}


def folded(text: str) -> str:
    """Lower case, as long as the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low if low.isascii() else low.translate(_ALIKE)


def token(text: str) -> str:
    """A suspect or a source as they are compared: NFC, case-folded, without what is no letter around it, single blanks."""
    text = re.sub(r"^[^\w]+|[^\w]+$", "", nfc(text).casefold().strip())
    return re.sub(r"\s+", " ", text)


_INTEGER = re.compile(r"(?<![\w.,])\d{1,6}(?![\w.,])")


def integer_words(n: int) -> str:
    """0 to 999,999 in words, as `numbers.spoken_integer`."""

    def two(n: int) -> str:
        ten, one = divmod(n, 10)
        if not ten:
            return DIGITS[one]
        ones = {0: "", 1: " mốt" if ten > 1 else " một", 5: " lăm"}.get(one, " " + DIGITS[one])
        return ("mười" if ten == 1 else f"{DIGITS[ten]} mươi") + ones

    def three(n: int, full: bool) -> str:
        hundred, rest = divmod(n, 100)
        if not hundred and not full:
            return two(rest)
        return f"{DIGITS[hundred]} trăm" + ("" if not rest else f" lẻ {DIGITS[rest]}" if rest < 10 else f" {two(rest)}")

    thousand, rest = divmod(n, 1000)
    if not thousand:
        return three(rest, False)
    return f"{three(thousand, False)} nghìn" + (f" {three(rest, rest < 100)}" if rest else "")


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    key: str
    category: str
    spoken: str


@dataclass
class Matcher:
    """The automaton of a lexicon's entries."""

    entries: tuple[Entry, ...]
    by_source: dict[str, list[tuple[int, str, Entry, str]]] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        for i, e in enumerate(self.entries):
            source = nfc(e.source)
            self.by_source.setdefault(folded(source), []).append((i, source, e, token(e.source)))
        self.automaton = ahocorasick.Automaton()
        for source, own in self.by_source.items():
            self.automaton.add_word(source, (len(source), own))
        self.automaton.make_automaton()

    def matches(self, text: str, only: set[str] | None = None, numbers: bool = False) -> list[Match]:
        """The matches in a text in NFC, in order, none overlapping. `only`: the tokens that may be replaced."""
        found, taken = [], {}
        is_word = lambda c: c.isalnum() or c == "_"
        for last, (n, own) in self.automaton.iter(folded(text)) if self.entries else ():
            start, end = last - n + 1, last + 1
            alone = None
            for i, source, e, name in own:
                if start < taken.get(i, 0) or (e.case_sensitive and text[start:end] != source):
                    continue
                if e.whole_word:
                    if alone is None:
                        alone = not (start and is_word(text[start - 1])) and not (end < len(text) and is_word(text[end]))
                    if not alone:
                        continue
                taken[i] = end
                if only is None or name in only:
                    found.append(Match(start, end, e.key, e.category, e.spoken))
        if numbers:
            for m in _INTEGER.finditer(text):
                if only is None or token(m.group()) in only:
                    found.append(Match(m.start(), m.end(), f"number:{m.group()}", "number", integer_words(int(m.group()))))
        found.sort(key=lambda m: (m.start, -m.end, m.key))
        out, until = [], 0
        for m in found:
            if m.start >= until:
                out.append(m)
                until = m.end
        return out


def rewritten(text: str, matches: list[Match]) -> str:
    out, at = [], 0
    for m in matches:
        out += [text[at : m.start], m.spoken]
        at = m.end
    return "".join([*out, text[at:]])


def unresolved(suspects: list[str], text: str, matches: list[Match]) -> list[str]:
    """The suspects that no match stands for, each once, in order."""
    done = {token(text[m.start : m.end]) for m in matches}
    return list(dict.fromkeys(s for s in suspects if token(s) and token(s) not in done))


@lru_cache(maxsize=4)
def _matcher(entries: tuple[Entry, ...]) -> Matcher:
    return Matcher(entries)


APPLIED = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("category", T.StringType()), T.StructField("source_text", T.StringType()), T.StructField("spoken_text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("key", pa.string()), ("category", pa.string()), ("source_text", pa.string()), ("spoken_text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spoken_form(df: DataFrame, entries: list[Entry], text: str = "text", suspects: str | None = None, numbers: bool = False) -> DataFrame:
    """`df` with canonical_text (the text in NFC), spoken_text, applied (key, category, source_text, spoken_text, start, end; in order,
    places from 0 in the canonical text) and unresolved. `suspects`: a column of arrays; then only what they name is replaced, and
    those that nothing was replaced for are unresolved. `numbers`: whole numbers up to six digits are said, too. A null text stays
    null, with nothing applied."""
    lexicon = df.sparkSession.sparkContext.broadcast(tuple(checked(list(entries))))
    fields = [T.StructField("canonical_text", T.StringType()), T.StructField("spoken_text", T.StringType()), T.StructField("applied", APPLIED), T.StructField("unresolved", T.ArrayType(T.StringType()))]

    def make():
        matcher = _matcher(lexicon.value)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text).to_pylist()
            asked = batch.column(suspects).to_pylist() if suspects else [None] * len(texts)
            canonical, said, applied, left = [], [], [], []
            for t, s in zip(texts, asked):
                t, s = None if t is None else nfc(t), [x for x in s or () if x and x.strip()]
                found = matcher.matches(t, {token(x) for x in s} if suspects else None, numbers) if t else []
                canonical.append(t)
                said.append(rewritten(t, found) if found else t)
                applied.append([{"key": m.key, "category": m.category, "source_text": t[m.start : m.end], "spoken_text": m.spoken, "start": m.start, "end": m.end} for m in found])
                left.append(unresolved(s, t or "", found))
            return [pa.array(canonical, pa.string()), pa.array(said, pa.string()), pa.array(applied, _ARROW), pa.array(left, pa.list_(pa.string()))]

        return run

    return add_columns(df, text, fields, make)


def _mark(k: int) -> str:
    return chr(0xE000 + k)


def marked_sql(text: str, entries: list[Entry], only: str | None = None) -> str:
    """SQL for the text in which each character of a match is its entry's mark, a private-use character; `only`: an array of lower-case
    sources that may be applied. For whole words of ASCII letters that overlap only where one holds the other. Without look-around a
    blank between two matches is taken by the first, so each entry is replaced twice."""
    for k, e in enumerate(entries):
        body = e.source if e.case_sensitive else f"(?i:{e.source})"
        once = lambda t: f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_]){body}($|[^\\p{{L}}\\p{{N}}_])', '\\1{_mark(k) * len(e.source)}\\2', 'g')"  # noqa: E731, B023
        new = once(once(text))
        text = new if only is None else f"CASE WHEN list_contains({only}, '{e.source.lower()}') THEN {new} ELSE {text} END"
    return text


def spans_sql(m: str, entries: list[Entry]) -> str:
    """SQL for `start:end:key` of each match in a marked text."""
    of = lambda values: "[" + ", ".join(values) + "]"
    marks, keys, sizes = of(f"'{_mark(k)}'" for k in range(len(entries))), of(f"'{e.key}'" for e in entries), of(str(len(e.source)) for e in entries)
    at = f"list_position({marks}, cs[i])"
    starts = f"list_filter(range(1, len(cs) + 1), lambda i: list_contains({marks}, cs[i]) AND (i = 1 OR cs[i - 1] <> cs[i]))"
    return f"(SELECT array_to_string(list_transform({starts}, lambda i: concat(i - 1, ':', i - 1 + {sizes}[{at}], ':', {keys}[{at}])), ',') FROM (SELECT string_split({m}, '') AS cs))"


def spoken_sql(m: str, entries: list[Entry]) -> str:
    for k, e in enumerate(entries):
        own = e.spoken.replace("'", "''")
        m = f"replace({m}, '{_mark(k) * len(e.source)}', '{own}')"
    return m
