"""An audit of claimed ranges against an archive's bytes, without decoding them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.roots import little_endian


def _at(offset: Column, size: int) -> Column:
    """Hex of ``size`` bytes at the offset."""
    return F.hex(F.substring(F.col("content"), (offset + 1).cast("int"), F.lit(size)))


def _tiles(first: str, end: str, low: Column, high: Column) -> Column:
    """Whether the members' ranges, one at least, cover [low, high) without a gap or an overlap."""
    placed = F.array_sort(F.transform("members", lambda m: F.struct(m[first].alias("first"), m["cd_index"].alias("k"), m[end].alias("end"))))
    n = F.size(placed)
    beside = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.get(placed, k)["first"] == F.get(placed, k - 1)["end"])).otherwise(F.array(F.lit(True)))
    return (F.get(placed, F.lit(0))["first"] == low) & (F.get(placed, n - 1)["end"] == high) & F.forall(placed, lambda x: x["end"] > x["first"]) & F.forall(beside, lambda x: x)


def audit(archives: DataFrame, claims: DataFrame, members: DataFrame) -> DataFrame:
    """(archive_id, code): covering.inconsistent for each claim that the bytes don't bear out, else null.

    ``claims``: archive_id, sha256, cd_offset, cd_size, end_offset, comment_size, count. ``members``: archive_id, cd_index,
    lfh_offset, payload_offset, packed, record_end, cdh_offset, cdh_end. The digest, the four ranges that cover the
    archive, the end record's fields, each record's signature and size, and both tilings must hold. A null claim fails.

    Plan: claims and members, some dozen bytes each, meet their archive's row; its bytes move once.
    """
    fields = ("cd_index", "lfh_offset", "payload_offset", "packed", "record_end", "cdh_offset", "cdh_end")
    listed = members.groupBy("archive_id").agg(F.collect_list(F.struct(*fields)).alias("members"))
    rows = claims.join(listed, "archive_id", "left").join(archives.select("archive_id", "content"), "archive_id", "left")
    count, size, offset, comment = (F.col(x) for x in ("count", "cd_size", "cd_offset", "comment_size"))
    end = F.concat(F.lit("504B050600000000"), little_endian(count, 2), little_endian(count, 2), little_endian(size, 4), little_endian(offset, 4), little_endian(comment, 2))
    whole = (
        (F.sha2("content", 256) == F.col("sha256")) & (offset >= 0) & (offset + size == F.col("end_offset"))
        & (F.col("end_offset") + 22 + comment == F.octet_length("content")) & (_at(F.col("end_offset"), 22) == end)
    )

    def record(m: Column) -> Column:
        sizes = (m["lfh_offset"] >= 0) & (m["payload_offset"] - m["lfh_offset"] >= 30) & (m["cdh_end"] - m["cdh_offset"] >= 46) & (m["packed"] >= 0) & (m["payload_offset"] + m["packed"] <= m["record_end"])
        return F.coalesce(sizes & (_at(m["lfh_offset"], 4) == "504B0304") & (_at(m["cdh_offset"], 4) == "504B0102"), F.lit(False))

    full = F.forall("members", record) & _tiles("lfh_offset", "record_end", F.lit(0).cast("long"), offset) & _tiles("cdh_offset", "cdh_end", offset, F.col("end_offset")) & (F.size("members") == count)
    good = whole & F.when(F.coalesce(F.size("members"), F.lit(0)) > 0, full).otherwise((count == 0) & (offset == 0))
    return rows.select("archive_id", F.when(~F.coalesce(good, F.lit(False)), "covering.inconsistent").alias("code"))
