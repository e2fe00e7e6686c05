"""Adding columns that are computed from a text column, without moving any other column through a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import CHUNK_BYTES, chunks


class Masked:
    """A table whose columns have got names that clash with nothing, and the way back.

    An operator that adds columns works on `df`; `restore` gives the input's columns their names again. A column of the input
    whose name is that of an added one, in any case, gives way to it."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*(f"_in{i}" for i in range(len(self.names))))

    def name(self, column: str) -> str:
        return f"_in{[n.lower() for n in self.names].index(column.lower())}"

    def as_string(self, df: DataFrame, column: str) -> tuple[DataFrame, str]:
        """`df` and the name in it of the input's column as a string."""
        name = self.name(column)
        if dict(df.dtypes)[name] == "string":
            return df, name
        return df.withColumn("_as_text", F.col(name).cast("string")), "_as_text"

    def restore(self, df: DataFrame, added: list[str], own: list[str] | None = None) -> DataFrame:
        """`own`: the names in `df` of the columns that are left, if not all are."""
        new = {a.lower() for a in added}
        old: list[Column] = [F.col(f"_in{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in new and (own is None or f"_in{i}" in own)]
        return df.select(*old, *added)


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], text: str = "text", limit: int = CHUNK_BYTES, owner: str = "") -> DataFrame:
    """`df` with `fields` behind its own columns, which must have other names. `make()` is called once a task and gives the
    function that turns a batch into the new columns' arrays. `owner`: whose cache the function uses (`words.CACHES`)."""
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_batch = make()
        for batch in chunks(batches, text, limit, owner):
            yield pa.RecordBatch.from_arrays([*batch.columns, *per_batch(batch)], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema.fields), *fields]))


def add_text_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], text: str = "text", owner: str = "") -> DataFrame:
    """As `add_columns`, for any input: names that clash give way, and the text may be of any type that casts to string."""
    m = Masked(df)
    rows, column = m.as_string(m.df, text)

    def per_task():
        per_text = make()
        return lambda batch: per_text(batch.column(column))

    return m.restore(add_columns(rows, fields, per_task, column, owner=owner), [f.name for f in fields])
