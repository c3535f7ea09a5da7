"""Archives admitted as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quayside.operators.admission import Caps
from quayside.operators.outcomes import inspect
from quayside.sources.archives import bounded


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, caps: Caps | None = None, *, max_files_a_batch: int = 1000, max_bytes: int = 512 << 20) -> StreamingQuery:
    """Inspect each new .zip file once and write its outcome as Parquet, a folder for each batch.

    Archives don't depend on each other, so there is no state and no watermark. A batch that runs again after a failure
    overwrites its own folder, so outcomes are neither lost nor doubled.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_a_batch).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        inspect(bounded(batch, max_bytes), caps, max_bytes=max_bytes).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
