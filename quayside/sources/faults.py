"""Archives with one known fault each: a corpus on which the checks can be held against their expected answers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.sources.archives import END, LOCAL, pack_bytes
from quayside.sources.batches import bound_batches, pieces

#: The kinds of faults by number, and where and how an archive that has one is stopped.
KINDS = [
    ("none", None, None), ("prefix", "structure", "format.unsupported"), ("local name", "structure", "zip.diff.a3_name"), ("local method", "structure", "zip.diff.a1_method"),
    ("local encryption", "structure", "zip.diff.a5_crypt"), ("local flags", "structure", "zip.flags"), ("local size", "structure", "zip.diff.a2_size"), ("local signature", "structure", "zip.diff.c1_stream"),
    ("listing signature", "structure", "zip.diff.c3_count"), ("comment", "structure", "zip.diff.c1_stream"), ("payload", "verification", "crc.mismatch"), ("parent path", "admission", "path.dotdot"),
    ("method", "admission", "method.unsupported"), ("encrypted", "admission", "zip.encrypted"), ("gap", "structure", "zip.diff.c1_stream"), ("cut", "structure", "format.unsupported"),
    ("hidden", "structure", "zip.diff.c1_stream"), ("alternate payload", "structure", "zip.diff.c1_stream"), ("too long", "source", "quota.archive"), ("absent", "source", "source.io"),
]


def _patched(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at + len(new) :]


def _described(name: str, payload: bytes) -> bytes:
    """A stored member whose sizes stand in a descriptor behind the payload."""
    raw, crc = name.encode(), zlib.crc32(payload)
    body = struct.pack("<4s5H3I2H", LOCAL, 20, 8, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw + payload + struct.pack("<4s3I", b"PK\x07\x08", crc, len(payload), len(payload))
    listing = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 0x0314, 20, 8, 0, 0, 0x21, crc, len(payload), len(payload), len(raw), 0, 0, 0, 0, 0, 0) + raw
    return body + listing + struct.pack("<4s4H2IH", END, 0, 0, 1, 1, len(listing), len(body), 0)


def faulty(name: str, data: bytes, kind: str) -> bytes | None:
    """An archive of one stored member that isn't empty, with that fault."""
    if kind == "absent":
        return None
    if kind == "hidden":
        return LOCAL + struct.pack("<4s4H2IH", END, 0, 0, 0, 0, 0, 4, 0)
    if kind == "alternate payload":
        return _described(name, data + LOCAL)
    whole = pack_bytes([("../" + name if kind == "parent path" else name, data)])
    at, end = len(whole) - 22 - 46 - len(name.encode()), len(whole) - 22
    payload = 30 + len(name.encode())
    if kind in ("method", "encrypted"):
        field, new = (8, b"\x0c") if kind == "method" else (6, bytes([whole[6] | 1]))
        return _patched(_patched(whole, field, new), at + field + 2, new)
    if kind == "gap":
        return _patched(whole[:at] + b"\0" + whole[at:], end + 17, struct.pack("<I", at + 1))
    small = {
        "local name": (30, b"~"), "local method": (8, b"\x08"), "local encryption": (6, bytes([whole[6] | 1])), "local flags": (6, bytes([whole[6] | 2])), "local size": (22, struct.pack("<I", len(data) + 1)),
        "local signature": (3, b"\0"), "listing signature": (at, b"XX"), "payload": (payload, bytes([whole[payload] ^ 1])),
    }
    if kind in small:
        return _patched(whole, *small[kind])
    return {"prefix": b"Z" + whole, "cut": whole[:-1], "comment": whole[:-2] + b"\x04\0" + LOCAL}.get(kind, whole)


def fault_corpus(members: DataFrame) -> DataFrame:
    """(archive_id, length, content) of ``members`` (archive_id, name, data binary, kind: a number of ``KINDS``): one archive each.

    An archive that is too long says so by its length and has no content, as a scan gives it. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [faulty(n, d, KINDS[k][0]) for n, d, k in zip(*(batch.column(x).to_pylist() for x in ("name", "data", "kind")), strict=True)]
            long = [KINDS[k][0] == "too long" for k in batch.column("kind").to_pylist()]
            lengths = [(1 << 40) if x else len(c or b"") for x, c in zip(long, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("archive_id"), pa.array(lengths, pa.int64()), pa.array([None if x else c for x, c in zip(long, made, strict=True)], pa.binary())], names=["archive_id", "length", "content"])

    bound_batches(members.sparkSession)
    return members.select("archive_id", "name", "data", F.col("kind").cast("int").alias("kind")).mapInArrow(run, "archive_id string, length long, content binary")
