"""Bounds on what a task holds of the Arrow batches between Spark and Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to Python or comes from it; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows and bytes of what is made into Python objects at a time.
PIECE_ROWS, PIECE_BYTES = 500, 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bound on Arrow batches to ``BATCH_BYTES``, unless it is lower. Rows alone (10,000 whole texts) bound no memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).removesuffix("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices, none of them copied: ``PIECE_ROWS`` rows at most, and as many as come to ``PIECE_BYTES`` at the batch's bytes a row.

    Python objects take many times a row's bytes, so a batch of 4 MiB of short rows would still be some hundred MB of them.
    """
    for batch in batches:
        rows = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))
