"""Line-first quality rules, by DataFrame functions only.

Each line is judged by rules on punctuation, navigation and boilerplate, and removed if it breaks one; what is left is the
cleaned text. Then the document is rejected if the lines left hold too little of its words. Documents that are too short, or
repeat themselves too much, fail before that.

Words are runs of characters other than space and U+0009 to U+000D. Repeated 8-word windows are found per document by
hashing: a word's hash is joined with its neighbours' (1, 2, 4, then 8 words), and only documents with equal window hashes
sort them. No step is worse than n log n in a document's words, and nothing is shuffled.

Defined results: null and empty texts have no words and fail as too short; their cleaned text is empty. Lines without a word
are left out of a cleaned text. Repeated rows are judged alike. Columns other than
the text are passed on; one named like an added column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import Masked

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Least words, largest share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line goes if over a third of its words bear symbols, or over two fifths are shouted ("!!"), or bars divide it, or it has
#: LEAST_SENTENCE words or more and none of the marks that sentences end with.
MOST_SYMBOLS, MOST_SHOUTED, LEAST_SENTENCE = 0.34, 0.4, 5
ENDS = "[.!?…。！？]"
#: Notices and rows of link labels have at most so many words.
SHORT = 25
#: Link labels between two or more separators.
NAVIGATION = r"^[^|»›>]{0,60}([|»›>][^|»›>]{0,60}){2,}$"
#: Fixed phrases of licence, cookie and copyright notices, in lower case, by language.
BOILERPLATE = {
    "en": ["licensed under the", "released under the", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "javascript is disabled", "javascript is required", "creative commons", "general public license", "copyright ©"],
    "fr": ["tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "politique de cookies", "mentions légales", "sous licence"],
    "de": ["alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "lizenziert unter"],
    "es": ["todos los derechos reservados", "términos de uso", "condiciones de uso", "política de privacidad", "política de cookies", "aviso legal", "bajo la licencia"],
}
NOTICE = "(?iu)(" + "|".join(p for phrases in BOILERPLATE.values() for p in phrases) + ")"
#: Least share of its words that a document must keep.
LEAST_KEPT = 0.5


def _line_fails(line: Column) -> Column:
    """Whether a line breaks a rule."""
    n = F.size(F.split(line, SPACE + "+"))
    symbols = F.regexp_count(line, F.lit(rf"{SYMBOLS}+"))
    shouted = F.regexp_count(line, F.lit(rf"!!(?={SPACE}|$)"))
    unended = (n >= LEAST_SENTENCE) & ~line.rlike(ENDS)
    return unended | (symbols > MOST_SYMBOLS * n) | (shouted > MOST_SHOUTED * n) | ((n <= SHORT) & (line.rlike(NAVIGATION) | line.rlike(NOTICE)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words_kept, kept and clean_text,
    the lines that broke no rule."""
    m = Masked(docs)
    out = m.df.withColumn("_text", F.coalesce(F.col(m.name(text)).cast("string"), F.lit("")))
    out = out.withColumn("_words", F.expr(r"filter(split(_text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_h": F.expr("transform(_words, w -> xxhash64(w))")})
    for width in (1, 2, 4):
        out = out.withColumn("_h", F.expr(f"slice(transform(_h, (h, i) -> xxhash64(h, get(_h, i + {width}))), 1, greatest(size(_h) - {width}, 0))"))
    # windows that occur twice or more, in order of their place
    out = out.withColumn("_sorted", F.expr("""CASE WHEN size(_h) > size(array_distinct(_h)) THEN array_sort(transform(_h, (h, i) -> named_struct('h', h, 'i', i))) END"""))
    out = out.withColumn("_twice", F.expr("""array_sort(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h OR x.h = get(_sorted, k + 1).h), x -> x.i))"""))
    # each covers 8 words, or as many as lie before the next
    covered = "aggregate(transform(_twice, (i, k) -> least(8, coalesce(get(_twice, k + 1) - i, 8))), 0L, (n, x) -> n + x)"
    lines = r"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    out = out.withColumns({"n_repeat_words": F.coalesce(F.expr(covered), F.lit(0).cast("long")), "_lines": F.expr(lines)})
    good = F.filter("_lines", lambda line: ~_line_fails(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))))
    out = out.withColumn("clean_text", F.array_join(good, "\n"))
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "line_words_kept": F.size(F.filter(F.split("clean_text", SPACE + "+"), lambda w: w != "")).cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~failed & (F.col("line_words_kept") >= LEAST_KEPT * F.col("n_words")))
    return m.restore(out, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_words_kept", "kept", "clean_text"])
