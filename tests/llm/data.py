"""Small inputs with every odd case, and brute-force versions."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
_SYLLABLES = ["ba", "ko", "ti", "re", "lum", "sta", "ne", "vor", "di", "sa"]


def words(text):
    return WORD.findall(text or "")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_rows():
    """(doc_id, text): nulls, blanks, copies, near copies, repeated rows, one very long text, odd characters."""
    a, b, c = prose(120, 1), prose(90, 2), prose(60, 3)
    near = " ".join([*a.split()[:50], "changed", *a.split()[51:]])
    rows = [(1, a), (2, near), (3, b), (4, a), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "one two"), (9, "one two"), (10, c + "\n" + b), (11, " ".join(["same"] * 300)), (12, "é x 日本語 👍 <|endoftext|> ▁"), (13, prose(30_000, 4)), (14, "x" * 50_000), (15, c), (None, c), (16, a + "\n" + a), (3, b)]
    return rows


def odd_docs(spark, rows=None):
    """With extra columns whose names clash with those that operators add or use inside."""
    rows = odd_rows() if rows is None else rows
    full = [(i, t, "en", f"src{(i or 0) % 3}" if i != 8 else None, len(t or ""), 7, "x", 0.5, 1, 2) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, score double, h int, p int").repartition(3)


def empty_docs(spark):
    return odd_docs(spark, []).limit(0)
