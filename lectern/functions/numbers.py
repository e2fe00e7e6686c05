"""Whole numbers in words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vietnamese digit words.
DIGITS = ["không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]


def _digit(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIGITS)), (n + 1).cast("int"))


def _two(n: Column) -> Column:
    """10 to 99."""
    ten, one = F.floor(n / 10), n % 10
    tens = F.when(ten == 1, F.lit("mười")).otherwise(F.concat(_digit(ten), F.lit(" mươi")))
    ones = F.when(one == 0, F.lit("")).when((one == 1) & (ten > 1), F.lit(" mốt")).when(one == 5, F.lit(" lăm")).otherwise(F.concat(F.lit(" "), _digit(one)))
    return F.concat(tens, ones)


def _three(n: Column, full: bool) -> Column:
    """1 to 999; `full` has the hundreds even where there are none."""
    hundred, rest = F.floor(n / 100), n % 100
    head = F.concat(_digit(hundred), F.lit(" trăm"))
    tail = F.when(rest == 0, F.lit("")).when(rest < 10, F.concat(F.lit(" lẻ "), _digit(rest))).otherwise(F.concat(F.lit(" "), _two(rest)))
    with_head = F.concat(head, tail)
    if full:
        return with_head
    return F.when(hundred > 0, with_head).when(rest < 10, _digit(rest)).otherwise(_two(rest))


def spoken_integer(n: Column) -> Column:
    """0 to 999,999 in words; null outside."""
    thousand, rest = F.floor(n / 1000), n % 1000
    high = F.concat(_three(thousand, False), F.lit(" nghìn"))
    return F.when((n < 0) | (n > 999_999), F.lit(None)).when(n == 0, F.lit(DIGITS[0])).when(thousand == 0, _three(rest, False)).when(rest == 0, high).otherwise(F.concat(high, F.lit(" "), _three(rest, True)))


_D = "(['không','một','hai','ba','bốn','năm','sáu','bảy','tám','chín'])"
WORDS_SQL = f"""
    WITH n AS (SELECT p_partkey, CAST(trunc(p_retailprice * 7) AS BIGINT) % 1000000 AS n FROM part),
    g AS (SELECT *, n // 1000 AS t, n % 1000 AS r FROM n),
    w AS (SELECT *, list_transform([t, r], lambda x: CASE WHEN x % 100 < 10 THEN {_D}[x % 100 + 1] ELSE
            (CASE WHEN x % 100 // 10 = 1 THEN 'mười' ELSE {_D}[x % 100 // 10 + 1] || ' mươi' END) ||
            (CASE WHEN x % 10 = 0 THEN '' WHEN x % 10 = 1 AND x % 100 // 10 > 1 THEN ' mốt' WHEN x % 10 = 5 THEN ' lăm' ELSE ' ' || {_D}[x % 10 + 1] END) END) AS two FROM g),
    h AS (SELECT *, {_D}[t // 100 + 1] || ' trăm' || (CASE WHEN t % 100 = 0 THEN '' WHEN t % 100 < 10 THEN ' lẻ ' || two[1] ELSE ' ' || two[1] END) AS th,
                    {_D}[r // 100 + 1] || ' trăm' || (CASE WHEN r % 100 = 0 THEN '' WHEN r % 100 < 10 THEN ' lẻ ' || two[2] ELSE ' ' || two[2] END) AS rh FROM w)
    SELECT p_partkey, n AS number, CASE WHEN n = 0 THEN 'không' WHEN t = 0 THEN (CASE WHEN r >= 100 THEN rh ELSE two[2] END)
        WHEN r = 0 THEN (CASE WHEN t >= 100 THEN th ELSE two[1] END) || ' nghìn'
        ELSE (CASE WHEN t >= 100 THEN th ELSE two[1] END) || ' nghìn ' || rh END AS words FROM h
"""
