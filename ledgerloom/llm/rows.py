"""Columns computed from a text column, added to the rows as they stream by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 512  # texts that are held as Python strings at once


def add_columns(df: DataFrame, text_col: str, fields: str, compute: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns of the DDL ``fields``, which ``compute`` gives for a list of texts.

    Columns of ``df`` with the new names (in any case) are replaced.
    """
    new = T.StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    rows = df.select(F.col(text_col).alias("__text"), *(c for c in df.columns if c.lower() not in names))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[1:]] + new.fields)
    header = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *compute(part.column(0).to_pylist())], header)

    return rows.mapInArrow(run, schema)
