"""Identities of archives: ordered digests of their content and of their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def little_endian(number: Column, width: int) -> Column:
    """Hex of the number's lowest ``width`` bytes, the lowest first."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(width)])


def _counted(blob: Column) -> Column:
    return F.concat(little_endian(F.octet_length(blob), 4), F.hex(blob))


def _range(offset: Column, size: Column) -> Column:
    return F.concat(little_endian(offset, 8), little_endian(size, 8))


def root_of(label: str, body: Column) -> Column:
    """SHA-256 of the label, a space, the body's length in decimals, a zero byte and the body (given in hex)."""
    head = F.concat(F.lit(label + " "), (F.length(body) / 2).cast("long").cast("string"))
    return F.sha2(F.unhex(F.concat(F.hex(head), F.lit("00"), body)), 256)


def _in_order(path: Column, blob: Column) -> Column:
    """The members' encodings in the order of their paths' bytes, after their number; null blobs are left out."""
    held = F.array_sort(F.collect_list(F.when(blob.isNotNull(), F.struct(path.alias("path"), blob.alias("blob")))))
    return F.concat(little_endian(F.size(held), 4), F.array_join(F.transform(held, lambda x: x["blob"]), ""))


def content_roots(members: DataFrame, label: str = "tree.content.v1") -> DataFrame:
    """(archive_id, root) of ``members`` (archive_id, path, is_dir, size, sha256, status); null unless all are verified.

    A row whose path is null says that the archive exists, and is no member. Members are a few dozen bytes each here,
    and an archive has at most as many as admission lets through.
    """
    kind = F.when(F.col("is_dir"), "02").otherwise("01")
    blob = F.concat(_counted(F.col("path").cast("binary")), kind, little_endian(F.col("size"), 8), F.col("sha256"))
    body = members.groupBy("archive_id").agg(_in_order(F.col("path"), blob).alias("body"), F.coalesce(F.bool_and(F.when(F.col("path").isNotNull(), F.coalesce(F.col("status") == "verified", F.lit(False)))), F.lit(True)).alias("all"))
    return body.select("archive_id", F.when(F.col("all"), root_of(label, F.col("body"))).alias("root"))


def layout_roots(decoded: DataFrame, members: DataFrame, label: str = "tree.layout.v1") -> DataFrame:
    """(archive_id, root) of decoded archives and their entries with ``path`` and ``is_dir`` added.

    The body: the four ranges that cover the archive, then each member's names, sizes, ranges, extra fields (by site,
    id and offset) and what normalising its path did.
    """
    extras = F.array_sort(F.transform("extras", lambda x: F.struct(x["site"].alias("site"), x["id"].alias("id"), x["at"].alias("at"), x["size"].alias("size"))))
    extra = F.array_join(F.transform(extras, lambda x: F.concat(little_endian(x["site"], 1), little_endian(x["id"], 2), F.lit("01"), little_endian(x["at"], 8), little_endian(x["size"], 2))), "")
    parts = F.split(F.col("name").cast("string"), "/")
    dots = F.filter(F.transform(parts, lambda x, k: F.when(x == ".", F.concat(F.lit("02"), little_endian(k, 4)))), lambda x: x.isNotNull())
    acts = F.concat(little_endian(F.size(dots) + F.col("is_dir").cast("int"), 4), F.when(F.col("is_dir"), "01").otherwise(""), F.array_join(dots, ""))
    described = F.col("flags").bitwiseAND(8) != 0
    after = F.col("payload_offset") + F.col("packed")
    blob = F.concat(
        _counted(F.col("path").cast("binary")), F.when(F.col("is_dir"), "02").otherwise("01"), _counted(F.col("name")), little_endian(F.col("method"), 2), little_endian(F.col("flags"), 2),
        little_endian(F.col("packed"), 8), little_endian(F.col("plain"), 8), little_endian(F.col("crc"), 4), _range(F.col("lfh_offset"), F.col("payload_offset") - F.col("lfh_offset")),
        _range(F.col("payload_offset"), F.col("packed")), F.when(described, F.concat(F.lit("01"), _range(after, F.col("record_end") - after))).otherwise("00"),
        _range(F.col("cdh_offset"), F.col("cdh_end") - F.col("cdh_offset")), little_endian(F.size("extras"), 4), extra, acts,
    )
    each = members.groupBy("archive_id").agg(_in_order(F.col("path"), blob).alias("body"))
    zero = F.lit(0)
    cover = F.concat(_range(zero, F.col("cd_offset")), _range(F.col("cd_offset"), F.col("cd_size")), _range(F.col("end_offset"), F.lit(22)), _range(F.col("end_offset") + 22, F.octet_length("comment")))
    whole = decoded.where("end_offset IS NOT NULL").select("archive_id", cover.alias("cover")).join(each, "archive_id", "left")
    return whole.select("archive_id", root_of(label, F.concat("cover", F.coalesce("body", F.lit("00000000")))).alias("root"))
