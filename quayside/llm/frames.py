"""Helpers for operators that add columns to a frame in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def with_columns_in_arrow(df: DataFrame, names: dict[str, T.DataType], make: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """``df`` with the columns that ``make`` gives for each batch; columns of those names in ``df`` are replaced."""
    fields = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(fields + [T.StructField(k, t) for k, t in names.items()])
    stay = [i for i, f in enumerate(df.schema.fields) if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = make(batch)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in stay] + [new[k] for k in names], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
