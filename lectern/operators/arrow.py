"""Columns computed in Python from one text column, batch by batch; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text that is looked at together; a longer single text is taken whole.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of `column`, or of one row."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def add_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], limit: int = CHUNK_BYTES) -> DataFrame:
    """`df` with `fields` behind its columns. `make()` runs once a task and gives the function from a batch to the new columns. A name
    that is there already, in any case, is an error."""
    clash = {f.name.lower() for f in fields} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_batch = make()
        for batch in chunks(batches, column, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns, *per_batch(batch)], names=[*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema.fields), *fields]))
