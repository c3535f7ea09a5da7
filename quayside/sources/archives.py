"""Archives as rows: packed from tables, scanned from files, and decoded into records.

The kernels here copy bytes into fields and make no decisions; every check is a column expression elsewhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.batches import BATCH_BYTES, bound_batches, pieces

LOCAL, CENTRAL, END, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x07\x08"
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")

ENTRY = (
    "cd_index int, cdh_offset long, cdh_end long, name binary, method int, flags int, crc long, packed long, plain long, lfh_offset long, "
    "attributes long, made_by int, comment binary, fixed boolean, ok boolean, extra_bad boolean, lfh_in boolean, lfh_ok boolean, lfh_name binary, lfh_method int, "
    "lfh_flags int, lfh_crc long, lfh_packed long, lfh_plain long, lfh_extra_bad boolean, payload_offset long, payload_in boolean, payload_signed boolean, "
    "extras array<struct<site:int,id:int,at:long,size:int>>, record_end long, descriptor_in boolean, descriptor_ok boolean, metadata long"
)
DECODED = f"archive_id string, length long, sha256 string, magic string, end_offset long, disk int, cd_disk int, this_count int, total_count int, cd_size long, cd_offset long, comment binary, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"


def bounded(files: DataFrame, max_bytes: int) -> DataFrame:
    """(archive_id, length, content) of ``files`` (path, length, content) that end in .zip in any case; content is null if too long.

    The two branches read different columns: the limit is pushed down to the file listing, and the content of longer files is
    never asked for.
    """
    zips = files.where(F.endswith(F.lower("path"), F.lit(".zip")))
    short = zips.where(F.col("length") <= max_bytes).select(F.col("path").alias("archive_id"), "length", "content")
    return short.union(zips.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary")))


def scan(spark: SparkSession, path: str, max_bytes: int = 512 << 20) -> DataFrame:
    """(archive_id, length, content) of the .zip files under ``path``. Links are not followed; sort by archive_id where order counts."""
    return bounded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_bytes)


def requested(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``found`` archives that ``wanted`` (archive_id) names, once each; those that aren't found have length 0 and no content, which inspections answer with source.io."""
    rows = wanted.select("archive_id").distinct().join(found, "archive_id", "left")
    return rows.select("archive_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"), "content")


def pack_bytes(members: list[tuple[str, bytes]], deflate: bool = False) -> bytes:
    """A plain archive of the members, in order; the same bytes for the same members."""
    body, central, at = [], [], 0
    for name, data in members:
        raw, crc, method = name.encode(), zlib.crc32(data), 0
        packed = data
        if deflate:
            engine = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed, method = engine.compress(data) + engine.flush(), 8
        common = (method, 0, 0x0021, crc, len(packed), len(data), len(raw), 0)
        flags = 0 if raw.isascii() else 0x800
        body += [_LOCAL.pack(LOCAL, 20, flags, *common), raw, packed]
        central += [_CENTRAL.pack(CENTRAL, 0x0314, 20, flags, *common, 0, 0, 0, 0o100644 << 16, at), raw]
        at += 30 + len(raw) + len(packed)
    listing = b"".join(central)
    return b"".join(body) + listing + _END.pack(END, 0, 0, len(members), len(members), len(listing), at, 0)


def pack(members: DataFrame, deflate: bool = False) -> DataFrame:
    """(archive_id, length, content) of ``members`` (archive_id, seq, name, data binary): one archive for each id.

    Members are sorted by archive, sequence number and name, and streamed: a task holds one archive at a time, as the
    archive must be one value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now, held = [], 0, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([len(c) for _, c in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], names=["archive_id", "length", "content"])

        for batch in pieces(batches):
            for key, name, data in zip(*(batch.column(k).to_pylist() for k in ("archive_id", "name", "data")), strict=True):
                if held and key != now:
                    out.append((now, pack_bytes(held, deflate)))
                    held, size = [], size + len(out[-1][1])
                    if size > BATCH_BYTES:
                        yield flush()
                        out, size = [], 0
                now = key
                held.append((name, data))
        if held:
            out.append((now, pack_bytes(held, deflate)))
        if out:
            yield flush()

    bound_batches(members.sparkSession)
    return members.select("archive_id", "seq", "name", "data").repartition("archive_id").sortWithinPartitions("archive_id", "seq", "name").mapInArrow(run, "archive_id string, length long, content binary")


def _extras(blob: bytes, site: int, base: int) -> tuple[bool, list[dict]]:
    """Whether the extra fields of one header (site 1: local, 2: central) are malformed, and those up to there; base is their offset."""
    found, at = {}, 0
    while at < len(blob):
        if at + 4 > len(blob):
            return True, [*found.values()]
        kind, size = struct.unpack_from("<HH", blob, at)
        at += 4 + size
        if at > len(blob) or kind in found:
            return True, [*found.values()]
        found[kind] = {"site": site, "id": kind, "at": base + at - size, "size": size}
    return False, [*found.values()]


def _signed(payload: bytes) -> bool:
    return any(x in payload for x in (LOCAL, CENTRAL, DESCRIPTOR))


def _entry(data: bytes, k: int, at: int, end: int, metadata: int) -> tuple[dict, int]:
    """The record at ``at`` of the listing that ends at ``end``, with its local header; ok is false if it is cut off.

    ``metadata``: bytes of metadata before it; the row has them with its own name and local extra fields.
    """
    row = {"cd_index": k, "cdh_offset": at, "ok": False, "fixed": at + 46 <= end and data[at : at + 4] == CENTRAL}
    if not row["fixed"]:
        return row, end + 1
    _, made, _, flags, method, _, _, crc, packed, plain, n, x, c, _, _, attributes, lfh = _CENTRAL.unpack_from(data, at)
    row |= {"method": method, "flags": flags, "crc": crc, "packed": packed, "plain": plain, "lfh_offset": lfh, "attributes": attributes, "made_by": made}
    stop = at + 46 + n + x + c
    if stop > end:
        return row, end + 1
    row["extra_bad"], extras = _extras(data[at + 46 + n : at + 46 + n + x], 2, at + 46 + n)
    row |= {"cdh_end": stop, "name": data[at + 46 : at + 46 + n], "comment": data[stop - c : stop], "ok": True, "lfh_extra_bad": False}
    row["lfh_in"] = lfh + 30 <= len(data)
    row["lfh_ok"] = row["lfh_in"] and data[lfh : lfh + 4] == LOCAL
    if row["lfh_ok"]:
        _, _, f, m, _, _, lcrc, lpacked, lplain, ln, lx = _LOCAL.unpack_from(data, lfh)
        start = lfh + 30 + ln + lx
        row["lfh_in"] = start <= len(data)
        row["lfh_extra_bad"], more = _extras(data[lfh + 30 + ln : start], 1, lfh + 30 + ln)
        extras += more
        row |= {"lfh_name": data[lfh + 30 : lfh + 30 + ln], "lfh_method": m, "lfh_flags": f, "lfh_crc": lcrc, "lfh_packed": lpacked, "lfh_plain": lplain, "payload_offset": start, "metadata": metadata + n + lx}
        row |= {"record_end": start + packed, "payload_in": start + packed <= len(data), "payload_signed": False, "descriptor_in": True, "descriptor_ok": True}
        if flags & 8:
            row["payload_signed"] = method == 0 and _signed(data[start : start + packed])
            tail = data[start + packed : start + packed + 16]
            signed = len(tail) >= 12 and tail[:4] == DESCRIPTOR
            fields = tail[4:16] if signed else tail[:12]
            row["record_end"] += 16 if signed else 12
            row["descriptor_in"] = len(fields) == 12
            row["descriptor_ok"] = row["descriptor_in"] and struct.unpack("<3I", fields) == (crc, packed, plain)
    return row | {"extras": extras}, stop


def decode_bytes(data: bytes, max_files: int) -> dict:
    """The end record and, if it has at most ``max_files`` entries within the data, all entries."""
    at = data.rfind(END, max(0, len(data) - 65557))
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(END, max(0, len(data) - 65557), at + 3) if at else -1
    if at < 0:
        return {}
    _, disk, cd_disk, this, total, size, offset, _ = _END.unpack_from(data, at)
    out = {"end_offset": at, "disk": disk, "cd_disk": cd_disk, "this_count": this, "total_count": total, "cd_size": size, "cd_offset": offset, "comment": data[at + 22 :], "entries": []}
    place, end, metadata = offset, offset + size, len(data) - at - 22 + size
    while total <= max_files and end == at and place < end and len(out["entries"]) <= max_files:
        row, place = _entry(data, len(out["entries"]), place, end, metadata)
        metadata = row.get("metadata") or metadata
        out["entries"].append(row)
    return out


def decode(archives: DataFrame, max_files: int = 10_000, *, with_content: bool = False) -> DataFrame:
    """The records of ``archives`` (archive_id, length, content), one row each; fields are null where there are none.

    magic: zip if the content begins as an archive does, gz, or unknown. ``with_content`` keeps the content beside them.
    No shuffle. A task holds a bounded part of its rows, however many and long they are; one archive is held whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(DECODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for i, length, digest, magic, content in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                rows.append({"archive_id": i, "length": length, "sha256": digest, "magic": magic} | (decode_bytes(content, max_files) if content is not None and magic == "zip" else {}))
            out = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(4)], names=[*arrow.names, "content"]) if with_content else out

    bound_batches(archives.sparkSession)
    first = F.hex(F.substring("content", 1, 3))
    magic = F.when(first.isin("504B03", "504B05") & (F.octet_length("content") >= 4), "zip").when(F.startswith(first, F.lit("1F8B")), "gz").otherwise("unknown")
    rows = archives.select("archive_id", "length", F.sha2("content", 256), F.when(F.col("content").isNotNull(), magic), "content")
    return rows.mapInArrow(run, DECODED + ", content binary" if with_content else DECODED)
