"""Verification of members: payloads are decoded in bounded pieces, and compared with what their records declare."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.sources.batches import bound_batches, pieces

PIECE = 64 << 10


def _pieces(data: bytes, method: int) -> Iterator[bytes]:
    """The decoded payload in pieces of 64 KiB; raises zlib.error for a broken or unfinished stream, EOFError for bytes after its end."""
    if method == 0:
        yield from (data[k : k + PIECE] for k in range(0, len(data), PIECE))
        return
    engine = zlib.decompressobj(-15)
    for k in range(0, len(data), PIECE):
        more = data[k : k + PIECE]
        while True:
            piece = engine.decompress(more, PIECE)
            yield piece
            more = engine.unconsumed_tail
            if engine.eof:
                if engine.unused_data or more or k + PIECE < len(data):
                    raise EOFError
                return
            if not more and len(piece) < PIECE:
                break
    raise zlib.error("unfinished")


def _measured(data: bytes, method: int, plain: int, crc: int) -> tuple[int, int, str | None, str | None]:
    """Size, CRC and SHA-256 of the decoded payload, and the finding; no more than a piece past the declared size is decoded."""
    size, own, digest = 0, 0, hashlib.sha256()
    try:
        for piece in _pieces(data, method):
            size += len(piece)
            if size > plain:
                return size, own, None, "quota.declared_lie"
            own = zlib.crc32(piece, own)
            digest.update(piece)
    except zlib.error:
        return size, own, None, "codec.deflate.invalid_stream"
    except EOFError:
        return size, own, None, "codec.deflate.trailing_input"
    code = "quota.declared_lie" if size != plain else "crc.mismatch" if own != crc else None
    return size, own, None if code else digest.hexdigest(), code


def verified(content: bytes, members: list[dict]) -> tuple[list[dict], str | None]:
    """One archive's members with size, crc, sha256 and status, decoded in order up to the first that fails; its code."""
    out, stop = [], None
    for m in members:
        row = {k: m[k] for k in ("cd_index", "path", "is_dir", "method", "packed", "plain", "payload_offset")} | {"size": None, "crc": None, "sha256": None, "code": None, "status": "pending"}
        if stop is None:
            end = m["payload_offset"] + m["packed"]
            if end > len(content):
                stop, row["size"] = "zip.diff.c4_offset", 0
            else:
                row["size"], row["crc"], row["sha256"], stop = _measured(content[m["payload_offset"] : end], m["method"], m["plain"], m["crc"])
            row |= {"code": stop, "status": "failed" if stop else "verified"}
        out.append(row)
    return out, stop


def verify(archives: DataFrame, members: DataFrame) -> DataFrame:
    """(archive_id, cd_index, size, crc, sha256, status, code) of ``members`` (archive_id, cd_index, method, packed, plain, crc, payload_offset).

    An archive's members are decoded in order, up to the first that fails: those before are verified, it has failed, those
    after stay pending and keep no result. A payload past the end of its archive is zip.diff.c4_offset. Plan: the members,
    some dozen bytes each, meet their archive in one equi-join, so its bytes move once; decoded bytes never leave the
    task, nor are they held whole.
    """
    fields = ("cd_index", "method", "packed", "plain", "crc", "payload_offset")
    listed = members.groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))
    rows = archives.select("archive_id", "content").join(listed, "archive_id")
    names = ["archive_id", "cd_index", "size", "crc", "sha256", "status", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for row in batch.to_pylist():
                plan = [m | {"path": None, "is_dir": None} for m in row["members"]]
                out += [{"archive_id": row["archive_id"]} | m for m in verified(row["content"], plan)[0]]
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in out], t) for k, t in zip(names, types, strict=True)], names=names)

    bound_batches(archives.sparkSession)
    return rows.mapInArrow(run, "archive_id string, cd_index int, size long, crc long, sha256 string, status string, code string")
