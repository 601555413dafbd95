"""Adds columns computed in Arrow batches to a DataFrame, with the other columns passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .textvec import chunks

#: Rows of an Arrow batch; with chunks() this bounds what a task holds.
BATCH_ROWS = "512"


def with_text_columns(df: DataFrame, text_col: str, fields: list[T.StructField], compute: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """df with the given columns appended; a column of the same name is replaced.

    compute(bytes, offsets) gets the UTF-8 bytes of some whole texts (null is empty) and the
    offsets between them, and returns one array (numpy or a list) per field.
    """
    names = {f.name for f in fields}
    kept = df.drop(*[c for c in df.columns if c in names and c != text_col])
    schema = T.StructType([*kept.schema.fields, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for first, end, raw, offs in chunks(batch.column(at)):
                made = compute(raw, offs)
                part = batch.slice(first, end - first)
                arrays = [*part.columns, *(pa.array(x, type=t) for x, t in zip(made, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return kept.mapInArrow(run, schema)
