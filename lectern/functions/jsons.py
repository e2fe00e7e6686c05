"""JSON of unknown shape: keys given twice, a canonical form, records that hold a text. Keys given twice are
told by expressions over the text's tokens, the others by Python's own parser, batch by batch; no schema is needed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.arrow import chunks
from ..session import ship

#: Strings, marks, and what stands between them.
TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'


def _unescaped(string: Column) -> Column:
    """The value of a JSON string token."""
    plain = F.substring(string, F.lit(2), F.length(string) - 2)
    return F.when(F.contains(string, F.lit("\\")), F.from_json(F.concat(F.lit("["), string, F.lit("]")), "array<string>")[0]).otherwise(plain)


def duplicate_keys(text: Column) -> Column:
    """The keys that an object of the JSON text gives more than once, at any depth, in order; a key given three times is told twice. Keys are
    compared by their value, escapes resolved. A null text gives null; text that is no JSON gives what its tokens say.

    A fold over the tokens with a stack of the open objects' keys; the cost grows with depth and keys of what is open, not with the text
    before it."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("stack"), F.lit("").alias("last"), none.alias("twice"))

    def step(acc: Column, t: Column) -> Column:
        stack, twice = acc["stack"], acc["twice"]
        below = F.slice(stack, F.lit(2), F.greatest(F.size(stack), F.lit(1)))

        def keyed(x: Column) -> Column:
            again = F.array_contains(x["top"], x["key"])
            return F.struct(F.when(again, stack).otherwise(F.concat(F.array(F.concat(x["top"], F.array(x["key"]))), below)).alias("stack"), t.alias("last"), F.when(again, F.concat(twice, F.array(x["key"]))).otherwise(twice).alias("twice"))

        key = F.struct(F.coalesce(F.get(stack, 0), none).alias("top"), _unescaped(acc["last"]).alias("key"))
        moved = F.when(t.isin("{", "["), F.concat(F.array(none), stack)).when(t.isin("}", "]"), below).otherwise(stack)
        return F.when(t == ":", _with(key, keyed)).otherwise(F.struct(moved.alias("stack"), t.alias("last"), twice.alias("twice")))

    return F.aggregate(tokens, start, step, lambda acc: acc["twice"])


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, though it is read many times."""
    return F.transform(F.array(value), then)[0]


def shortest_float(token: Column) -> Column:
    """A JSON number with a fraction or an exponent in the shortest form that gives the same double: 1.5, 100000.0, 1e+16, 1e-05. Up to
    15 digits these are the token's own; beyond, those of the double."""
    same = lambda x, value: F.when(x.try_cast("double") == value, x)
    # the engine's own text may have digits too many
    of_double = _with(token.try_cast("double"), lambda v: F.coalesce(same(F.format_string("%.15e", v), v), same(F.format_string("%.16e", v), v), F.lower(v.cast("string"))))
    given = F.length(F.regexp_replace(F.regexp_replace(token, "[eE].*$", ""), "^-?0*\\.?0*|[-.]|0+$", ""))
    return _with(F.when(given <= 15, F.lower(token)).otherwise(of_double), _parted)


def _parted(text: Column) -> Column:
    sign = F.when(text.startswith("-"), "-").otherwise("")
    power = F.coalesce(F.regexp_extract(text, r"e([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    parts = F.struct(F.regexp_extract(text, r"^-?([0-9.]+)", 1).alias("mantissa"), power.alias("power"))

    def normal(p: Column) -> Column:
        digits = F.replace(p["mantissa"], F.lit("."), F.lit(""))
        led = F.regexp_replace(digits, "^0+", "")
        # the point stands behind so many digits
        point = F.length(F.substring_index(p["mantissa"], ".", 1)) - (F.length(digits) - F.length(led)) + p["power"]
        return _with(F.struct(F.regexp_replace(led, "0+$", "").alias("own"), point.alias("point")), _written_out)

    return F.concat(sign, _with(parts, normal))


def _written_out(x: Column) -> Column:
    own, point, n, exponent = x["own"], x["point"], F.length(x["own"]), x["point"] - 1
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), own))
        .when(point >= n, F.concat(own, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(own, F.lit(1), point), F.lit("."), F.substring(own, point + 1, n)))
    )
    rest = F.substring(own, F.lit(2), n)
    size = F.abs(exponent).cast("string")
    powered = F.concat(F.substring(own, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size))
    return F.when(n == 0, "0.0").when(exponent.between(-4, 15), plain).otherwise(powered)


#: One text for all values that are equal.
_FORM = {"ensure_ascii": False, "sort_keys": True, "separators": (",", ":")}


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is given twice")
    return out


def _refused(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON")


def _parsed(text: str) -> object:
    return json.loads(text, object_pairs_hook=_once, parse_constant=_refused)


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """A JSON text with the keys of every object in code-point order, no blanks, strings with no escape but the necessary ones, whole numbers as they
    are and others in their shortest form: one text for all that mean the same, and the one whose digest other systems take. Null if the
    text is no JSON, nests deeper than Python reads, has a number that no double holds, or an object gives a key twice."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(_parsed(t), allow_nan=False, **_FORM).encode("utf-8", "replace").decode()
        except (ValueError, RecursionError):
            return None

    return text.map(one).astype(object)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(text), 256)


def records_with(rows: DataFrame, keys: list[str], text: str, sought: str) -> DataFrame:
    """keys, path, record (JSON): every object of the JSON column, at any depth, whose own strings, numbers and truth values, joined by blanks, hold
    `sought`. Each text is parsed and walked once; nothing is shuffled or written. Rows whose text is no JSON have no records."""
    ship(rows.sparkSession)
    own = rows.select(*keys, F.col(text).alias("_json"))
    fields = [T.StructField("path", T.StringType()), T.StructField("record", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_json"):
            found = [(i, *f) for i, t in enumerate(batch.column("_json").to_pylist()) if t for f in _holders(t, sought)]
            at = pa.array([i for i, *_ in found], pa.int64())
            columns = [*(c.take(at) for c in batch.columns[:-1]), pa.array([p for _, p, _ in found], pa.string()), pa.array([r for *_, r in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "path", "record"])

    return own.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in own.schema.fields[:-1]), *fields]))


def _holders(text: str, sought: str) -> list[tuple[str, str]]:
    """Path and text of each record that holds `sought`."""
    out = []
    try:
        todo = [("$", _parsed(text))]
        while todo:
            path, value = todo.pop()
            if isinstance(value, dict):
                if sought in " ".join(str(x) for x in value.values() if isinstance(x, (str, int, float))):
                    out.append(tuple(x.encode("utf-8", "replace").decode() for x in (path, json.dumps(value, **_FORM))))
                todo += [(f"{path}.{k}", x) for k, x in value.items() if isinstance(x, (dict, list))]
            elif isinstance(value, list):
                todo += [(f"{path}[{i}]", x) for i, x in enumerate(value) if isinstance(x, (dict, list))]
    except (ValueError, RecursionError):
        return []
    return out
