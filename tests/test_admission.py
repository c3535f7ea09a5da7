"""Decoding, structural checks, path rules and admission checks on constructed archives."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quayside.functions.jail import canonical, path_code, ratio_exceeds
from quayside.operators import admission, structure
from quayside.sources.archives import decode, pack_bytes

GOOD = pack_bytes([("bundle/config.json", b'{"safe":true}\n'), ("bundle/hello.txt", b"hello\n")])


def patched(at: int, new: bytes) -> bytes:
    return GOOD[:at] + new + GOOD[at + len(new) :]


CENTRAL_AT = GOOD.index(b"PK\x01\x02")
CASES = {
    "good": (GOOD, None),
    "deflate": (pack_bytes([("a.txt", b"x" * 50)], deflate=True), None),
    "empty": (pack_bytes([]), None),
    "short": (b"PK", "format.unsupported"),
    "noise": (b"x" * 100, "format.unsupported"),
    "cut": (GOOD[:-1], "format.unsupported"),
    "none": (None, "format.unsupported"),
    "name": (patched(30, b"B"), "zip.diff.a3_name"),
    "method": (patched(8, b"\x08"), "zip.diff.a1_method"),
    "crypt": (patched(6, b"\x01"), "zip.diff.a5_crypt"),
    "flags": (patched(6, b"\x02"), "zip.flags"),
    "size": (patched(18, b"\x01"), "zip.diff.a2_size"),
    "signature": (patched(3, b"\0"), "zip.diff.c1_stream"),
    "magic": (patched(0, b"XX"), "format.unsupported"),
    "gzip": (b"\x1f\x8b" + GOOD, "format.unsupported"),
    "central": (patched(CENTRAL_AT, b"XX"), "zip.diff.c3_count"),
    "count": (patched(len(GOOD) - 14, b"\x03"), "zip.diff.c3_count"),
    "prefix": (b"Z" + GOOD, "format.unsupported"),
    "gap": (GOOD[:44] + b"PK" + GOOD[44:], "zip.diff.c4_offset"),
    "hidden": (b"PK\x03\x04" + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0, 0, 0, 4, 0), "zip.diff.c1_stream"),
}


def one(payload=b"data", *, flags=0, method=0, name=b"m", central=b"", local=b"", comment=b"", descriptor=b"", lname=None, lmethod=None, sizes=None, lsizes=None, offset=0, names=None) -> bytes:
    """One member with those fields; l...: of the local header, where they differ."""
    sizes = sizes or (zlib.crc32(payload), len(payload), len(payload))
    lname, lmethod = name if lname is None else lname, method if lmethod is None else lmethod
    lsizes = lsizes or ((0, 0, 0) if flags & 8 else sizes)
    body = struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, flags, lmethod, 0, 0x21, *lsizes, len(lname), len(local)) + lname + local + payload + descriptor
    listing = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 0x0314, 20, flags, method, 0, 0x21, *sizes, len(name) if names is None else names, len(central), len(comment), 0, 0, 0, offset) + name + central + comment
    return body + listing + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 1, 1, len(listing), len(body), 0)


def extra(*ids: int) -> bytes:
    return b"".join(struct.pack("<HH", k, 2) + b"xx" for k in ids)


def described(payload=b"data", wrong=0, signed=True) -> bytes:
    return (b"PK\x07\x08" if signed else b"") + struct.pack("<3I", zlib.crc32(payload) ^ wrong, len(payload), len(payload))


BIG = 0xFFFFFFFF
#: One fault each, then pairs of faults: the one that is looked at first is the answer.
CASES |= {
    "described": (one(flags=8, descriptor=described()), None), "unsigned": (one(flags=8, descriptor=described(signed=False)), None),
    "alternate": (one(b"xPK\x03\x04x", flags=8, descriptor=described(b"xPK\x03\x04x")), "zip.diff.c1_stream"), "plain payload": (one(b"xPK\x03\x04x"), None),
    "descriptor differs": (one(flags=8, descriptor=described(wrong=1)), "zip.diff.a2_size"), "no descriptor": (one(flags=8)[:35] + one(flags=8)[35:], "zip.diff.a2_size"),
    "placeholders": (one(flags=8, descriptor=described(), lsizes=(1, 0, 0)), "zip.diff.a2_size"), "described past the end": (one(flags=8, sizes=(zlib.crc32(b"data"), 4000, 4), lsizes=(0, 0, 0)), "zip.diff.c4_offset"),
    "descriptor past the end": (one(flags=8, method=8, sizes=(zlib.crc32(b"data"), 102, 4), lsizes=(0, 0, 0)), "zip.diff.c4_offset"),
    "extra": (one(central=extra(7, 9), local=extra(7)), None), "twice": (one(central=extra(7, 7)), "zip.extra"), "cut extra": (one(local=extra(7)[:-1]), "zip.extra"),
    "zip64 extra": (one(local=extra(1)), "zip.diff.c5_zip64"), "unicode path": (one(central=extra(0x7075)), "zip.diff.a3_name"), "sentinel": (one(sizes=(0, BIG, BIG)), "zip.diff.c5_zip64"),
    "comment": (one(comment=b"PK\x05\x06"), "zip.diff.c2_eocd"), "header past the end": (one(offset=5000), "zip.diff.c4_offset"), "long local name": (one()[:26] + b"\xff\x0f" + one()[28:], "zip.diff.c4_offset"),
    "encoding": (one(name=b"\xe9"), "zip.encoding"), "flagged": (one(name="é".encode(), flags=0x800), None), "directory with bytes": (one(name=b"d/"), "zip.diff.a4_dir"),
    "sentinel, then overflow": (one(sizes=(0, BIG, BIG), names=9999), "zip.diff.c5_zip64"), "overflow": (one(names=9999), "zip.diff.c3_count"),
    "central extra, then header": (one(central=extra(7, 7), offset=5000), "zip.extra"), "header, then local extra": (one(local=extra(1), offset=5000), "zip.diff.c4_offset"),
    "central extra, then comment": (one(central=extra(0x7075), comment=b"PK\x05\x06"), "zip.diff.a3_name"), "comment, then local extra": (one(comment=b"PK\x05\x06", local=extra(1)), "zip.diff.c2_eocd"),
    "central twice, then local zip64": (one(central=extra(7, 7), local=extra(1)), "zip.extra"), "zip64, then twice": (one(central=extra(1, 7, 7)), "zip.diff.c5_zip64"), "twice, then zip64": (one(central=extra(7, 7, 1)), "zip.extra"),
    "local extra, then name": (one(local=extra(1), lname=b"x"), "zip.diff.c5_zip64"), "name, then method": (one(lname=b"x", lmethod=8), "zip.diff.a3_name"), "method, then sizes": (one(lmethod=8, lsizes=(1, 1, 1)), "zip.diff.a1_method"),
    "sizes, then encoding": (one(name=b"\xe9", lsizes=(1, 1, 1)), "zip.diff.a2_size"), "encoding, then payload": (one(b"xPK\x03\x04x", name=b"\xe9", flags=8, descriptor=described(b"xPK\x03\x04x")), "zip.encoding"),
    "payload, then descriptor": (one(b"xPK\x03\x04x", flags=8, descriptor=described(wrong=1)), "zip.diff.c1_stream"),
}


@pytest.fixture(scope="module")
def codes(spark):
    rows = [(k, len(v[0] or b""), bytearray(v[0]) if v[0] is not None else None) for k, v in CASES.items()]
    decoded = decode(spark.createDataFrame(rows, "archive_id string, length long, content binary"))
    return {r.archive_id: r.code for r in structure.first_failures(decoded).collect()}


@pytest.mark.parametrize("name", CASES)
def test_first_failure(codes, name):
    assert codes.get(name) == CASES[name][1]


def test_metadata_is_counted_member_by_member(spark):
    data = pack_bytes([("a" * 100, b""), ("b" * 100, b"")])
    decoded = decode(spark.createDataFrame([("x", len(data), bytearray(data))], "archive_id string, length long, content binary"))
    size = 2 * 146 + 200  # the listing, and the names again for their local headers
    code = lambda cap: decoded.select(structure.first_failure(max_metadata=cap).alias("c")).first().c
    assert [code(x) for x in (size, size - 1, size - 101, 291)] == [None, "quota.metadata", "quota.metadata", "quota.metadata"]


def test_any_prefix_or_flipped_byte_gives_a_row(spark):
    rows = [(f"p{k}", k, bytearray(GOOD[:k])) for k in range(0, len(GOOD), 7)]
    rows += [(f"x{k}", len(GOOD), bytearray(patched(k, bytes([GOOD[k] ^ 0xFF])))) for k in range(0, len(GOOD), 5)]
    assert decode(spark.createDataFrame(rows, "archive_id string, length long, content binary")).count() == len(rows)


@pytest.mark.parametrize(
    ("raw", "code"),
    [("a/b.txt", None), ("./a", None), ("a\0b", "path.nul"), ("é", "path.unicode"), ("a\\b", "path.invalid_char"), ("/a", "path.absolute"), ("C:x", "path.absolute"), ("a//b", "path.empty"), ("", "path.empty"), (".", "path.empty"), ("a/../b", "path.dotdot"), ("file.txt:s", "path.ads"), ("a?b", "path.invalid_char"), ("a.", "path.trailing"), ("...", "path.trailing"), ("x/con.txt", "path.reserved"), ("/".join("a" * 33), "path.depth")],
)
def test_path_rules(spark, raw, code):
    got = spark.createDataFrame([(raw,)], "raw string").select(path_code(F.col("raw")).alias("c"), canonical(F.col("raw")).alias("p")).first()
    assert got.c == code and (raw != "./a" or got.p == "a")


def test_ratio_is_exact(spark):
    top = (1 << 63) - 1
    rows = [(0, 0, 5), (1, 0, 5), (500, 5, 100), (501, 5, 100), (top, 1, top), (top, 1, top - 1), (7, 1, 0), (9, 1, None)]
    got = spark.createDataFrame(rows, "u long, c long, r long").select("u", "c", "r", ratio_exceeds(F.col("u"), F.col("c"), F.col("r")).alias("x")).collect()
    assert all(r.x == (r.r is not None and (r.u > 0 if r.c == 0 else r.u > r.r * r.c)) for r in got)


def test_admission_findings(spark):
    names = ["a", "a/b", "A", "x", "x", "d/", "../up", "ok"]
    rows = [("z", k, n, 0, 0, 10, 10) for k, n in enumerate(names)]
    members = spark.createDataFrame(rows, "archive_id string, cd_index int, raw string, flags int, method int, packed long, plain long")
    got = {r.cd_index: r.code for r in admission.findings(members).collect()}
    assert got == {1: "path.conflict", 2: "path.case_fold", 4: "zip.diff.b1_dup", 6: "path.dotdot"}
    over = {r.cd_index: r.code for r in admission.findings(members.where("cd_index IN (0, 3, 7)"), admission.Caps(max_total_bytes=15)).collect()}
    assert over == {3: "quota.total"}


def test_archive_summary_sums_decoded_entries(spark, tmp_path, monkeypatch):
    from quayside import queries

    docs = [(1, "abc", "en", "s1"), (2, "é" * 5, "de", "s1"), (3, "", "en", "s2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    packed = queries._packed
    monkeypatch.setattr(queries, "_packed", lambda *a: packed(*a).where("archive_id != '1'"))
    assert {tuple(r) for r in queries.archive_summary(spark, str(tmp_path)).collect()} == {("s1", 1, 10), ("s2", 1, 0)}
