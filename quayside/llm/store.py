"""Tables kept in the shared folder that the cluster names, so that lost executors cost only a read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quayside.sources.batches import bound_batches

__all__ = ["bound_batches", "keep", "shared_folder"]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a temporary folder in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-quayside-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it again: cuts the lineage, keeps column pruning."""
    path = f"{shared_folder(df.sparkSession)}/quayside-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
