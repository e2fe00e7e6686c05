"""Column functions on text: normal forms, redaction, extraction, tokens. All are built-in expressions but `nfc`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Marks a place where a blank may have to go; no text holds it after `normalize`.
_MARK = "\x1f"
TERMINAL = ".!?…:;\"'”’"
TOKEN = r"[0-9]+|\p{L}+(?:[-']\p{L}+)*"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for. Only for input that isn't NFC already."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize(text: Column) -> Column:
    """One newline form, single blanks, none before and one after punctuation, at most one blank line in a row, trimmed."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda line: F.trim(F.regexp_replace(line, "[ \t]+", " "))), "\n")
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    t = F.regexp_replace(t, r"([,.;:!?])", "$1" + _MARK)
    t = F.regexp_replace(t, _MARK + r"(\s)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, _MARK + "$", ""), _MARK, " ")
    return F.btrim(F.regexp_replace(t, "\n{3,}", "\n\n"), F.lit(" \n\t"))


def spoken(normalized: Column, separator: str = "\n\n") -> Column:
    """Paragraphs that end without a terminal mark get a full stop; empty ones go."""
    paragraphs = F.filter(F.transform(F.split(normalized, separator), lambda p: F.btrim(p, F.lit(" \n\t"))), lambda p: p != "")
    closed = F.transform(paragraphs, lambda p: F.when(F.instr(F.lit(TERMINAL), F.right(p, F.lit(1))) > 0, p).otherwise(F.concat(p, F.lit("."))))
    return F.array_join(closed, separator)


def in_nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


#: What lower case and case folding make of a character differently: for one character and for several.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.lower() == c and c.casefold() != c}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_MANY = {c: f for c, f in _FOLDED.items() if len(f) > 1 and c != "ß"}


def _ranges(chars: str, gap: int = 16) -> str:
    """Ranges of a character class that has all of `chars`, and others between neighbours."""
    codes = sorted(map(ord, chars))
    starts = [c for c, before in zip(codes, [-gap - 1, *codes]) if c - before > gap]
    ends = [c for c, after in zip(codes, [*codes[1:], 1 << 30]) if after - c > gap]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: A text with none of these is folded by lower case and ß alone; a wider class costs time, no result. Sigma's lower case hangs on its place.
_SPECIAL = "[\u00b5-\U0001ffff&&[Σ" + _ranges("".join(c for c in map(chr, range(0x80, 0x20000)) if c.lower().replace("ß", "ss") != c.casefold())) + "]]"


def casefold(text: Column) -> Column:
    """Unicode case folding. Texts of letters that fold to lower case (and ß) take that alone; those with a character that folds to several
    are rare, and folded letter by letter."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    folds = F.create_map(*(F.lit(x) for pair in _MANY.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(folds, c), c)), "")
    one = "".join(_ONE), "".join(_ONE.values())
    rare = F.when(low.rlike("[" + _ranges("".join(_MANY)) + "]"), F.translate(spelled, *one)).otherwise(F.translate(low, *one))
    return F.when(text.rlike(_SPECIAL), rare).otherwise(low)


def label(text: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def plain(text: Column) -> Column:
    """Everything but letters, digits and underscores as single blanks, lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def bounded(text: Column, most: int) -> Column:
    """Collapsed and cut to `most` characters; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most), F.lit(""))


def redact(text: Column, most: int | None = None) -> Column:
    """Bearer tokens, JSON web tokens and e-mail addresses replaced, then cut if a length is given."""
    t = F.regexp_replace(text, r"(?i)bearer\s+[a-z0-9._~+/=-]+", "Bearer [redacted]")
    t = F.regexp_replace(t, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[jwt]")
    # a run of characters is looked at from its start alone, or from where the address before ended; a text without @ not at all
    mail = F.regexp_replace(t, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    t = F.when(F.contains(t, F.lit("@")), mail).otherwise(t)
    return t if most is None else F.substring(t, 1, most)


def bare_urls(text: Column) -> Column:
    """URLs in free text without query and fragment."""
    return F.regexp_replace(text, r"(https?://[^\s\"'?#<>]+)[^\s\"'<>]*", "$1")


def bare_url(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)


def file_name(path: Column) -> Column:
    """The last part of a path, control characters and separators as underscores."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"[\x00-\x1f:*?\"<>|]", "_")


def counter(text: Column, part: int) -> Column:
    """Number 1 or 2 of the first `n / m` with thousands separators."""
    digits = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9., ]*)/\s*([0-9][0-9., ]*)", part), "[^0-9]", "")
    return F.nullif(digits, F.lit("")).cast("long")


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b([0-9]{1,15})\b", 1), F.lit("")).cast("long")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def hits(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in the list's order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def sentences(text: Column) -> Column:
    """Runs up to and with their terminal marks, trimmed, empty ones gone. A line's end ends a sentence."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?…\n]+[.!?…]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def short_id(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


# Labels of the four pauses; case doesn't matter.
_SECONDS = r"\s*[−-]\s*([0-9]+(?:\.[0-9]+)?)s"
PAUSES = {"dot_seconds": r"Dấu chấm\s*[•.]?", "comma_seconds": r"Dấu phẩy\s*,?", "semicolon_seconds": r"Dấu chấm phẩy\s*;?", "newline_seconds": r"Xuống dòng\s*¶?"}


def pause_values(text: Column) -> dict[str, Column]:
    """The four pauses in seconds that a text tells; one that isn't there fails the query by its name."""
    line = F.regexp_replace(text, r"\s+", " ")
    found = {k: F.regexp_extract(line, "(?iu)" + label + _SECONDS, 1) for k, label in PAUSES.items()}
    return {k: F.when(v != "", v.cast("double")).otherwise(F.raise_error(F.lit(f"pause value {k} not found")).cast("double")) for k, v in found.items()}


def decoded(base64: Column) -> Column:
    """The bytes of base 64 text in lines."""
    return F.unbase64(F.regexp_replace(base64, r"\s+", ""))


#: Latin letters with marks, and those without that engines compare alike.
_MARKED, _BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def bare_letters(text: Column) -> Column:
    """Lower case without the marks of Latin letters; what is no ASCII character then is dropped."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _BARE), r"[^\x00-\x7F]", "")


def bare_letters_sql(text: str) -> str:
    return f"regexp_replace(translate(lower({text}), '{_MARKED}', '{_BARE}'), '[^\\x00-\\x7F]', '', 'g')"
