"""Verification, outcomes, the covering audit, roots and the folder stream on constructed archives."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quayside.operators import admission, covering, outcomes, roots, structure, verification
from quayside.sources.archives import decode, pack_bytes
from quayside.streaming.watch import watch

LONG = b"".join(hashlib.sha256(struct.pack("<I", k)).digest() for k in range(8000))
DEFLATED = pack_bytes([("a.bin", LONG), ("b/c.txt", b"hello"), ("empty", b"")], deflate=True)
PLAIN = pack_bytes([("b/c.txt", b"hello"), ("./a.txt", b"x"), ("d/", b"")]).replace(struct.pack("<I", 0o100644 << 16), b"\0\0\0\0")


def with_payload(payload: bytes, plain: int, crc: int) -> bytes:
    """One deflated member with that payload and those claims."""
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0, 8, 0, 0x21, crc, len(payload), plain, 1, 0) + b"m" + payload
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 0x0314, 20, 0, 8, 0, 0x21, crc, len(payload), plain, 1, 0, 0, 0, 0, 0, 0) + b"m"
    return local + central + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 1, 1, len(central), len(local), 0)


def raw(data: bytes) -> bytes:
    engine = zlib.compressobj(6, zlib.DEFLATED, -15)
    return engine.compress(data) + engine.flush()


HELLO, CRC = raw(b"hello" * 9), zlib.crc32(b"hello" * 9)
CASES = {
    "good": (DEFLATED, "ALLOWED"), "plain": (PLAIN, "ALLOWED"), "empty": (pack_bytes([]), "ALLOWED"), "payload": (with_payload(HELLO, 45, CRC), "ALLOWED"),
    "crc": (with_payload(HELLO, 45, CRC ^ 1), "crc.mismatch"), "more": (with_payload(HELLO, 44, CRC), "quota.declared_lie"), "less": (with_payload(HELLO, 46, CRC), "quota.declared_lie"),
    "trailing": (with_payload(HELLO + b"x", 45, CRC), "codec.deflate.trailing_input"), "cut": (with_payload(HELLO[:-1], 45, CRC), "codec.deflate.invalid_stream"),
    "noise": (with_payload(b"\xff" * 9, 45, CRC), "codec.deflate.invalid_stream"), "bomb": (with_payload(raw(b"\0" * 10_000_000), 900_000, 0), "quota.declared_lie"),
    "path": (pack_bytes([("../x", b""), ("ab:c", b""), ("../y", b"")]), "path.dotdot+path.ads+path.dotdot"), "junk": (b"x" * 50, "format.unsupported"), "gone": (None, "source.io"),
}


@pytest.fixture(scope="module")
def archives(spark):
    return spark.createDataFrame([(k, len(v or b""), v, "clash") for k, (v, _) in CASES.items()], "archive_id string, length long, content binary, code string")


def test_outcomes(archives):
    got = {r.archive_id: r for r in outcomes.inspect(archives.drop("code")).collect()}
    assert {k: r.result for k, r in got.items()} == {k: v for k, (_, v) in CASES.items()}
    assert (got["cut"].interpretation, got["cut"].admission, got["cut"].verification) == ("malformed", "not-evaluated", "partial")
    assert (got["crc"].interpretation, got["crc"].admission, got["crc"].exit_code) == ("interpreted", "denied", 2)
    assert (got["junk"].interpretation, got["junk"].admission, got["gone"].interpretation) == ("unsupported", "not-evaluated", "indeterminate")
    assert (got["good"].verdict, got["good"].exit_code, got["path"].phase) == ("allowed", 0, "admission")
    assert outcomes.inspect(archives.limit(0)).count() == 0
    small = {r.archive_id: r for r in outcomes.inspect(archives, max_bytes=100).collect()}
    assert (small["good"].result, small["good"].admission) == ("quota.archive", "denied")


def test_verification_stops_at_the_first_failure(spark):
    three = bytearray(pack_bytes([("a", b"one"), ("b", b"two"), ("c", b"three")]))
    three[three.index(b"two")] ^= 1
    table = spark.createDataFrame([("x", bytes(three))], "archive_id string, content binary").withColumn("length", F.octet_length("content").cast("long"))
    got = verification.verify(table, structure.entries(decode(table))).orderBy("cd_index").collect()
    assert [(r.status, r.code) for r in got] == [("verified", None), ("failed", "crc.mismatch"), ("pending", None)]
    assert got[0].sha256 == hashlib.sha256(b"one").hexdigest() and got[1].sha256 is None and got[2].size is None


def _claims(decoded):
    return decoded.select("archive_id", "sha256", "cd_offset", "cd_size", "end_offset", F.octet_length("comment").alias("comment_size"), F.col("total_count").alias("count"))


def test_covering_audit(archives):
    whole = archives.where("archive_id IN ('good', 'plain', 'empty', 'path')").drop("code")
    decoded = decode(whole)
    claims, members = _claims(decoded), structure.entries(decoded)
    found = lambda c, m: {r.archive_id: r.code for r in covering.audit(whole, c, m).collect()}
    assert found(claims, members) == dict.fromkeys(("good", "plain", "empty", "path"))
    wrong = "covering.inconsistent"
    assert found(claims.withColumn("sha256", F.lit("0")), members)["good"] == wrong
    assert set(found(claims.withColumn("count", F.col("count") + 1), members).values()) == {wrong}
    assert found(claims, members.withColumn("record_end", F.col("record_end") + 1))["plain"] == wrong
    assert found(claims, members.where("cd_index > 0"))["path"] == wrong
    assert found(claims, members.withColumn("cdh_offset", F.lit(None).cast("long")))["good"] == wrong


def _root(label, body):
    return hashlib.sha256(f"{label} {len(body)}".encode() + b"\0" + body).hexdigest()


def test_roots_against_the_encoding(archives):
    whole = archives.where("archive_id IN ('plain', 'empty')").drop("code")
    decoded = decode(whole)
    each = structure.entries(decoded).withColumn("raw", structure.decoded_name())
    members = each.join(admission.judged_members(each, admission.Caps()).select("archive_id", "cd_index", "path", "is_dir"), ["archive_id", "cd_index"])
    checked = verification.verify(whole, members).select("archive_id", "cd_index", "size", "sha256", "status")
    flat = members.select("archive_id", "cd_index", "path", "is_dir").join(checked, ["archive_id", "cd_index"])
    files = [("a.txt", 1, b"x"), ("b/c.txt", 1, b"hello"), ("d", 2, b"")]
    body = struct.pack("<I", 3) + b"".join(struct.pack("<I", len(p)) + p.encode() + struct.pack("<BQ", k, len(d)) + hashlib.sha256(d).digest() for p, k, d in files)
    assert {r.archive_id: r.root for r in roots.content_roots(flat, "t").collect()} == {"plain": _root("t", body)}
    assert roots.content_roots(flat.withColumn("status", F.lit("pending")), "t").first().root is None
    layout = {r.archive_id: r.root for r in roots.layout_roots(decoded, members, "t").collect()}
    assert layout["empty"] == _root("t", struct.pack("<8Q", 0, 0, 0, 0, 0, 22, 22, 0) + b"\0\0\0\0")
    d = {r["path"]: r for r in members.where("archive_id = 'plain'").collect()}
    end = decoded.where("archive_id = 'plain'").first()
    body = struct.pack("<8Q", 0, end.cd_offset, end.cd_offset, end.cd_size, end.end_offset, 22, end.end_offset + 22, 0) + struct.pack("<I", 3)
    for path, kind, data in files:
        r, act = d[path], {"a.txt": struct.pack("<IBI", 1, 2, 0), "d": struct.pack("<IB", 1, 1)}.get(path, struct.pack("<I", 0))
        body += struct.pack("<I", len(path)) + path.encode() + bytes([kind]) + struct.pack("<I", len(r["name"])) + bytes(r["name"]) + struct.pack("<2H2QI", 0, 0, len(data), len(data), zlib.crc32(data))
        body += struct.pack("<4Q", r.lfh_offset, r.payload_offset - r.lfh_offset, r.payload_offset, len(data)) + b"\0" + struct.pack("<2Q", r.cdh_offset, r.cdh_end - r.cdh_offset) + struct.pack("<I", 0) + act
    assert layout["plain"] == _root("t", body)


def test_corpus_counts_and_gate(archives):
    found = outcomes.corpus_counts(outcomes.inspect(archives.drop("code")), F.lit("c"))
    got = {r.result: (r.n, r["first"]) for r in found.collect()}
    assert got["ALLOWED"] == (4, "empty") and got["quota.declared_lie"] == (3, "bomb")
    assert outcomes.corpus_gate(found, found).count() == 0
    assert {(r.n, r.expected_n) for r in outcomes.corpus_gate(found.where("result = 'ALLOWED'"), found.where("result != 'source.io'")).collect()} >= {(None, 3), (None, 1)}


def test_watch_inspects_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.zip").write_bytes(DEFLATED)
    (folder / "note.txt").write_bytes(b"x")
    ask = lambda: watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    ask()
    (folder / "B.ZIP").write_bytes(b"junk")
    ask()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.archive_id.rsplit("/", 1)[1], r.result) for r in got) == [("B.ZIP", "format.unsupported"), ("a.zip", "ALLOWED")]


def test_registered_queries_against_brute_force(spark, tmp_path):
    from quayside import queries

    docs = [(1, "x" * 33_000, "en", "s1"), (2, "x" * 33_000, "de", "s1"), (3, "some words", "en", "s1"), (4, "other words", "de", "s2"), (5, "more words " * 20, "fr", "s2"), (6, "y" * 40_000, "fr", "s2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for d, text, lang, _ in docs:
        code = "quota.ratio" if len(text) > 100 * len(raw(text.encode())) else "path.absolute" if lang == "de" else None  # the ratio is looked at before the path
        want[str(d)] = (code and "admission", code, code or "ALLOWED", "denied" if code else "admitted", 2 if code else 0)
    assert [want[k][1] for k in "126"] == ["quota.ratio"] * 3
    got = queries.archive_outcomes(spark, str(tmp_path)).collect()
    assert {r.archive_id: (r.phase, r.code, r.result, r.admission, r.exit_code) for r in got} == want and len(got) == len(docs)
    count = lambda s, x: sum(want[str(d[0])][2] == x for d in docs if d[3] == s)
    cells = {(s, x): count(s, x) for s in ("s1", "s2") for x in ("ALLOWED", "path.absolute", "quota.ratio") if count(s, x)}
    assert {(r["class"], r.result): r.n for r in queries.corpus_counts(spark, str(tmp_path)).collect()} == cells
    gate = {(r["class"], r.result): (r.n, r.expected_n) for r in queries.corpus_gate(spark, str(tmp_path)).collect()}
    assert gate == {(s, x): (n, 3 if x == "ALLOWED" else None) for (s, x), n in cells.items()}
