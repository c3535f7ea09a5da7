"""Structural checks of decoded archives: the first that fails, in the order of the format's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.sources.archives import CENTRAL, DESCRIPTOR, END, LOCAL

_U32, _U16 = 0xFFFFFFFF, 0xFFFF
ZIP64_EXTRA, UNICODE_PATH_EXTRA = 0x0001, 0x7075
_ZIP64_END, _ZIP64_LOCATOR = b"PK\x06\x06", b"PK\x06\x07"


def _has(blob: Column, *signs: bytes) -> Column:
    return F.coalesce(sum((F.contains(blob, F.lit(s)).cast("int") for s in signs), F.lit(0)) > 0, F.lit(False))


def _comment_code(blob: Column) -> Column:
    return F.when(_has(blob, _ZIP64_END, _ZIP64_LOCATOR), "zip.diff.c5_zip64").when(_has(blob, END), "zip.diff.c2_eocd").when(_has(blob, LOCAL, CENTRAL, DESCRIPTOR), "zip.diff.c1_stream")


def archive_code(max_files: int, max_metadata: int) -> Column:
    """The first failing check of the archive's end record, or null."""
    return (
        F.when(F.coalesce(F.col("magic"), F.lit("unknown")) != "zip", "format.unsupported")
        .when((F.col("length") < 22) | F.col("end_offset").isNull(), "format.unsupported")
        .when(_comment_code(F.col("comment")).isNotNull(), _comment_code(F.col("comment")))
        .when((F.col("disk") != 0) | (F.col("cd_disk") != 0) | (F.col("this_count") != F.col("total_count")), "zip.diff.c3_count")
        .when(F.col("total_count") > max_files, "quota.files")
        .when((F.col("cd_size") == _U32) | (F.col("cd_offset") == _U32) | (F.col("total_count") == _U16), "zip.diff.c5_zip64")
        .when(F.octet_length("comment") + F.col("cd_size") > max_metadata, "quota.metadata")
        .when(F.col("cd_offset") + F.col("cd_size") != F.col("end_offset"), "zip.diff.c4_offset")
    )


def _name_of(e) -> Column:
    text = e("name").cast("string")
    ascii_only = ~F.hex(e("name")).rlike("^(..)*[89A-F]")
    return F.when(ascii_only | ((e("flags").bitwiseAND(0x800) != 0) & F.is_valid_utf8(text)), text)


def decoded_name(entry: Column | None = None) -> Column:
    """The name as text if it is ASCII, or valid UTF-8 with its flag set; else null."""
    return _name_of(F.col if entry is None else entry.getField)


def _directory_code(e) -> Column:
    """Names that end in a slash must be stored, empty directories; others must not claim to be directories or special files."""
    is_dir = F.endswith(e("name"), F.lit(b"/"))
    kind = F.shiftright(e("attributes"), 16).bitwiseAND(0xF000)
    dos = e("attributes").bitwiseAND(0x10) != 0
    wrong_dir = (e("method") != 0) | (e("packed") != 0) | (e("plain") != 0) | (e("crc") != 0) | ~kind.isin(0, 0x4000)
    return F.when(is_dir & wrong_dir, "zip.diff.a4_dir").when(~is_dir & (dos | ~kind.isin(0, 0x8000)), "zip.diff.a4_dir")


def _extra_code(e, site: int, bad: str) -> Column:
    """The first fault of one header's extra fields: those before a malformed one come first."""
    denied = F.filter(e("extras"), lambda x: (x["site"] == site) & x["id"].isin(ZIP64_EXTRA, UNICODE_PATH_EXTRA))
    first = F.get(denied, F.lit(0))["id"]
    return F.when(first == ZIP64_EXTRA, "zip.diff.c5_zip64").when(first == UNICODE_PATH_EXTRA, "zip.diff.a3_name").when(e(bad), "zip.extra")


def member_code(entry: Column | None = None, max_metadata: int = 4 << 20) -> Column:
    """The first failing check of one entry (columns, or a struct), or null; how entries lie to each other: ``layout_code``."""
    e = F.col if entry is None else entry.getField
    flags_differ = e("flags").bitwiseXOR(e("lfh_flags"))
    described = e("flags").bitwiseAND(8) != 0
    pairs = [("packed", "lfh_packed"), ("plain", "lfh_plain"), ("crc", "lfh_crc")]
    plain_differ, held = F.lit(False), F.lit(False)
    for a, b in pairs:
        plain_differ = plain_differ | (e(a) != e(b))
        held = held | ((e(b) != 0) & (e(a) != e(b)))
    central, local, directory, comment = _extra_code(e, 2, "extra_bad"), _extra_code(e, 1, "lfh_extra_bad"), _directory_code(e), _comment_code(e("comment"))
    return (
        F.when(~e("fixed"), "zip.diff.c3_count")
        .when((e("packed") == _U32) | (e("plain") == _U32) | (e("lfh_offset") == _U32), "zip.diff.c5_zip64")
        .when(~e("ok"), "zip.diff.c3_count")
        .when(central.isNotNull(), central)
        .when(comment.isNotNull(), comment)
        .when(~e("lfh_in") & ~e("lfh_ok"), "zip.diff.c4_offset")
        .when(~e("lfh_ok"), "zip.diff.c1_stream")
        .when(~e("lfh_in"), "zip.diff.c4_offset")
        .when(local.isNotNull(), local)
        .when(e("name") != e("lfh_name"), "zip.diff.a3_name")
        .when(e("method") != e("lfh_method"), "zip.diff.a1_method")
        .when(flags_differ.bitwiseAND(1) != 0, "zip.diff.a5_crypt")
        .when(flags_differ != 0, "zip.flags")
        .when(~described & plain_differ, "zip.diff.a2_size")
        .when(described & held, "zip.diff.a2_size")
        .when(_name_of(e).isNull(), "zip.encoding")
        .when(directory.isNotNull(), directory)
        .when(described & (e("method") == 0) & ~e("payload_in"), "zip.diff.c4_offset")
        .when(e("payload_signed"), "zip.diff.c1_stream")
        .when(~e("descriptor_in"), "zip.diff.c4_offset")
        .when(~e("descriptor_ok"), "zip.diff.a2_size")
        .when(e("metadata") > max_metadata, "quota.metadata")
    )


def layout_code() -> Column:
    """How an archive's records lie, from its row: past the listing or over each other zip.overlap, with bytes between, before
    or after them that none has zip.diff.c1_stream."""
    placed = F.array_sort(F.transform("entries", lambda e: F.struct(e["lfh_offset"].alias("start"), e["cd_index"].alias("k"), e["record_end"].alias("stop"))))
    n = F.size("entries")
    beside = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(F.get(placed, k - 1)["stop"].alias("end"), F.get(placed, k)["start"].alias("start"))))
    apart = F.get(F.filter(beside, lambda x: x["end"] != x["start"]), F.lit(0))
    return (
        F.when(n == 0, F.when(F.col("cd_offset") != 0, "zip.diff.c1_stream"))
        .when(F.exists("entries", lambda e: e["record_end"] > F.col("cd_offset")), "zip.overlap")
        .when(F.get(placed, F.lit(0))["start"] != 0, "zip.diff.c1_stream")
        .when(apart["end"] > apart["start"], "zip.overlap")
        .when(apart["end"] < apart["start"], "zip.diff.c1_stream")
        .when(F.get(placed, n - 1)["stop"] != F.col("cd_offset"), "zip.diff.c1_stream")
    )


def first_failure(max_files: int = 10_000, max_metadata: int = 4 << 20) -> Column:
    """The first structural check that a decoded archive fails, or null: a projection of its row."""
    members = F.get(F.filter(F.transform("entries", lambda e: member_code(e, max_metadata)), lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(archive_code(max_files, max_metadata), members, F.when(F.size("entries") != F.col("total_count"), "zip.diff.c3_count"), layout_code())


def entries(decoded: DataFrame) -> DataFrame:
    """One row for each entry, in listing order."""
    return decoded.select("archive_id", "cd_offset", "length", F.explode("entries").alias("e")).select("archive_id", "cd_offset", "length", "e.*")


def layout_codes(records: DataFrame) -> DataFrame:
    """(archive_id, code) of archives whose records (archive_id, cd_index, start, stop, limit) don't tile [0, limit).

    Overlaps are zip.overlap; a gap, a first record that isn't at 0 or a last one that ends before the limit are
    zip.diff.c1_stream; a record past the limit is zip.overlap. Ranges are compared with the one before by a window.
    """
    order = Window.partitionBy("archive_id").orderBy("start", "cd_index")
    last = F.lead("start").over(order).isNull()
    before = F.lag("stop").over(order)
    code = (
        F.when(F.col("stop") > F.col("limit"), F.struct(F.lit(0).alias("phase"), F.col("cd_index").cast("long").alias("at"), F.lit("zip.overlap").alias("code")))
        .when(before.isNull() & (F.col("start") != 0), F.struct(F.lit(1).alias("phase"), F.lit(-1).cast("long").alias("at"), F.lit("zip.diff.c1_stream").alias("code")))
        .when(before > F.col("start"), F.struct(F.lit(1).alias("phase"), F.col("start").alias("at"), F.lit("zip.overlap").alias("code")))
        .when(before < F.col("start"), F.struct(F.lit(1).alias("phase"), F.col("start").alias("at"), F.lit("zip.diff.c1_stream").alias("code")))
        .when(last & (F.col("stop") != F.col("limit")), F.struct(F.lit(2).alias("phase"), F.col("stop").alias("at"), F.lit("zip.diff.c1_stream").alias("code")))
    )
    return records.withColumn("c", code).where("c IS NOT NULL").groupBy("archive_id").agg(F.min("c").alias("c")).select("archive_id", F.col("c.code").alias("code"))


def first_failures(decoded: DataFrame, max_files: int = 10_000, max_metadata: int = 4 << 20) -> DataFrame:
    """(archive_id, code): the first structural check that each archive fails; archives without one aren't there."""
    return decoded.select("archive_id", first_failure(max_files, max_metadata).alias("code")).where("code IS NOT NULL")
