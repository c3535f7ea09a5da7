"""Connected components by joins, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.store import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to its least neighbour. Edges: (u, v) both ways, or u > v.

    The least are written first, so that the join has plain exchanges on both sides and a node of very many links can be split.
    """
    least = keep(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    linked = edges.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = out.where(F.col("u") != F.col("v"))
    return out if large else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the least node reachable.

    Alternates large and small stars until nothing changes: a number of rounds that grows with the logarithm of
    the size, each of joins and pre-aggregated minima, with the edges kept in the shared folder between rounds.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = keep(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = keep(_star(_star(both, large=True), large=False), "edges")
