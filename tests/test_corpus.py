"""The fault corpus, the gate, policies, documents and the folder sink."""

import hashlib
import json
import os
import re
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quayside.operators import gate, outcomes, roots
from quayside.operators.admission import Caps, scan, with_paths
from quayside.operators.documents import documents
from quayside.operators.policy import Policy
from quayside.operators.structure import entries
from quayside.sinks import folder
from quayside.sources.archives import decode, pack_bytes
from quayside.sources.faults import KINDS, fault_corpus, faulty

TABLE = "archive_id string, length long, content binary"
TREE = pack_bytes([("a/b.txt", b"hello"), ("c.bin", b"".join(hashlib.sha256(bytes([k & 255, k >> 8])).digest() for k in range(7200)))], deflate=True)


def table(spark, **archives):
    return spark.createDataFrame([(k, len(v or b""), v and bytearray(v)) for k, v in archives.items()], TABLE)


@pytest.fixture(scope="module")
def faults(spark):
    rows = [(str(k), f"d/{k}.txt", bytearray(b"some text"), k) for k in range(len(KINDS))]
    return fault_corpus(spark.createDataFrame(rows, "archive_id string, name string, data binary, kind int"))


def test_each_fault_is_answered(faults):
    got = {r.archive_id: (r.phase, r.code) for r in outcomes.inspect(faults).collect()}
    assert got == {str(k): (phase, code) for k, (_, phase, code) in enumerate(KINDS)}
    assert faulty("n", b"x", "none") == pack_bytes([("n", b"x")])


def member(k, path, is_dir=False, plain=1, own=None, jail=None):
    return {"cd_index": k, "path": path, "is_dir": is_dir, "plain": plain, "own": own, "jail": jail}


def test_a_scan_compares_with_accepted_members_only():
    codes = lambda *m, top=100: [c for _, c in scan(list(m), top)]
    assert codes(member(0, "a"), member(1, "a/b")) == codes(member(0, "a/b"), member(1, "a")) == ["path.conflict"]
    assert codes(member(0, "a/b"), member(1, "A")) == codes(member(0, "A"), member(1, "a/b")) == ["path.case_fold"]
    assert codes(member(0, "a", own="zip.encrypted"), member(1, "a")) == ["zip.encrypted"]  # a rejected member hides nothing
    assert codes(member(0, "a"), member(1, "a/b"), member(2, "a/b/c")) == ["path.conflict"] * 2
    assert codes(member(0, "a", True), member(1, "a/b"), member(2, "a", True)) == ["zip.diff.b1_dup"]
    assert codes(member(0, None, jail="path.ads"), member(1, "b", plain=100), member(2, None, jail="path.ads")) == ["path.ads", "quota.total"]


def test_the_gate_says_what_differs(spark, faults):
    found = outcomes.inspect(faults).withColumn("path", F.concat(F.lit("x/zoo/"), "archive_id")).withColumn("class", gate.class_of(F.col("path")))
    counts = {}
    for _, _, code in KINDS:
        counts[code or "ALLOWED"] = counts.get(code or "ALLOWED", 0) + 1
    lines = [f"count zoo {r} {n}" for r, n in counts.items()]
    text = "\n".join(["# all", "", f"total {len(KINDS)}", "digest sha256 " + "ab" * 32, *lines, "allow x/zoo/0"])
    good = gate.read_expectations(text)
    assert gate.differences(found, good, "ab" * 32).count() == 0
    wrong = gate.read_expectations(text.replace("allow x/zoo/0", "allow x/zoo/77").replace("count zoo source.io 1", "count zoo gone 1"))
    got = {tuple(r) for r in gate.differences(found, wrong, "cd" * 32).collect()}
    assert got == {("digest", "", "ab" * 32, "cd" * 32), ("count", "zoo/gone", "1", "0"), ("count", "zoo/source.io", "0", "1"), ("allow", "x/zoo/77", "allowed", "rejected"), ("allow", "x/zoo/0", "rejected", "allowed")}
    assert gate.differences(found.limit(0), good).where("kind = 'total'").first().actual == "0"
    for bad in ("total 1", text + "\ntotal 3", text + "\nallow x/zoo/0", text + "\nnonsense", text.replace("total 20", "total 21"), text + "\nallow x/zoo/1", text.replace("ab" * 32, "ab")):
        with pytest.raises(ValueError):
            gate.read_expectations(bad)


def test_corpus_digest_is_over_paths_in_order(spark):
    rows = [("b/x", 3, b"abc"), ("a/é", 1, b"z"), ("b", 0, b"")]
    frame = spark.createDataFrame([(p, n, hashlib.sha256(d).hexdigest()) for p, n, d in rows], "path string, length long, sha256 string").repartition(3)
    whole = b"".join(struct.pack("<Q", len(p.encode())) + p.encode() + struct.pack("<Q", n) + hashlib.sha256(d).digest() for p, n, d in sorted(rows, key=lambda r: r[0].encode()))
    assert gate.corpus_digest(frame) == hashlib.sha256(whole).hexdigest()


def fixture_text():
    path = Path(__file__).resolve().parent.parent / "FIXTURES.md"
    return path.read_text() if path.exists() else pytest.skip("no fixture document")


def test_pinned_digests(spark):
    """The digests that the fixture document pins: the default policy and the roots of its allowed archive."""
    text = fixture_text()
    pinned = lambda name: re.search(rf"\| {name}[^|]*\| `([0-9a-f]{{64}})`", text)[1]
    label = re.search(r"label `(\w+)\.tree\.layout\.v1`", text)[1]
    own = Policy(schema=f"{label}.policy.v1", id=f"{label}:policy/default/v1")
    assert own.digest() == pinned("default policy JSON")
    data = pack_bytes([(p, d.replace("\\n", "\n").encode()) for p, d in re.findall(r"\| \d+ \| `(bundle/[\w.]+)` = `([^`]+)` \|", text)])
    assert hashlib.sha256(data).hexdigest() == pinned("`allowed.zip` bytes")
    archives = table(spark, allowed=data)
    found = outcomes.members_of(outcomes.inspected(archives))
    assert roots.content_roots(found, f"{label}.tree.content.v1").first().root == pinned("allowed content root")
    decoded = decode(archives)
    assert roots.layout_roots(decoded, with_paths(entries(decoded)), f"{label}.tree.layout.v1").first().root == pinned("allowed layout root")


def test_policies_reserve_what_is_not_supported(spark):
    assert Policy().unsupported() is None and Policy(max_ratio=None, atomic=True, max_files=3, id="x").unsupported() is None
    assert all(Policy(**{k: v}).unsupported() for k, v in {"symlinks": "allow", "formats": ("zip", "gz"), "nested_depth": 2, "schema": "v2", "max_dict_bytes": 1}.items())
    assert Policy(max_files=3).caps() == Caps(max_files=3) and Policy().digest() != Policy(max_files=3).digest()
    got = documents(outcomes.inspected(table(spark, a=TREE)), Policy(encrypted="allow")).first()
    view = json.loads(got.view)
    assert view["findings"] == [{"code": "policy.unsupported", "severity": "error"}] and view["verdict"] == "rejected" and view["members"] == [] and view["interpretation"]["status"] == "indeterminate"


def test_documents(spark):
    broken = bytearray(pack_bytes([("z", b"one"), ("b", b"two"), ("c", b"three")]))
    broken[broken.index(b"two")] ^= 1
    late = pack_bytes([("z/", b""), ("a", b"x")]).replace(struct.pack("<I", 0o100644 << 16), b"\0\0\0\0")
    got = {r.archive_id: r for r in documents(outcomes.inspected(table(spark, good=late, broken=bytes(broken), path=pack_bytes([("../x", b"")])))).collect()}
    view = {k: json.loads(r.view) for k, r in got.items()}
    assert [m["path"] for m in view["good"]["members"]] == ["a", "z"] and view["good"]["members"][1] == {"path": "z", "kind": "dir", "comp_bytes": 0, "uncomp_bytes": 0, "method": "store", "crc32": "00000000", "sha256": hashlib.sha256(b"").hexdigest()}
    assert [m["path"] for m in view["broken"]["members"]] == ["z"] and view["broken"]["verification"] == {"status": "partial", "verified_members": 1, "pending_members": 2}
    assert view["broken"]["view_completeness"] == {"status": "partial", "phase": "verification", "cause": "crc.mismatch"} and view["path"]["findings"] == [{"code": "path.dotdot", "severity": "error"}]
    for r in got.values():
        assert r.view_sha256 == hashlib.sha256(r.view.encode()).hexdigest() == json.loads(r.receipt)["view_digest"]["sha256"]


def test_publishing(spark, tmp_path):
    os.chmod(tmp_path, 0o700)
    archives = table(spark, good=TREE, bad=pack_bytes([("../x", b"x")]), taken=TREE, dirs=pack_bytes([("e/", b""), ("f", b"1")]).replace(struct.pack("<I", 0o100644 << 16), b"\0\0\0\0"))
    (tmp_path / "taken").mkdir()
    report = lambda: {r.archive_id: r for r in folder.publish(archives, str(tmp_path), name="archive_id", sync=True).collect()}
    for _ in range(2):  # a task that runs again finds its own work
        got = report()
        assert (got["good"].outcome, got["good"].files, got["good"].bytes, got["good"].published) == ("committed", 2, 5 + 256 * 900, f"{tmp_path}/good")
        assert (got["bad"].outcome, got["taken"].outcome, got["taken"].code, got["dirs"].files) == ("not-started", "setup-failed", "materialize.exists", 1)
    assert (tmp_path / "good/a/b.txt").read_bytes() == b"hello" and (tmp_path / "dirs/e").is_dir() and not list((tmp_path / "taken").iterdir())
    assert sorted(os.listdir(tmp_path)) == ["dirs", "good", "taken"]
    (tmp_path / "good/more").write_bytes(b"x")
    assert report()["good"].code == "materialize.exists"
    assert (tmp_path / "good/c.bin").stat().st_mode & 0o777 == 0o600


def test_publishing_refuses_unsafe_places(tmp_path):
    os.chmod(tmp_path, 0o700)
    content = b"data"
    row = {"path": "l/x", "is_dir": False, "method": 0, "packed": 4, "plain": 4, "size": 4, "sha256": hashlib.sha256(content).hexdigest(), "payload_offset": 0}
    code = lambda parent, name, *m: folder.publish_one(str(parent), name, list(m), content, False)["code"]
    wide = tmp_path / "wide"
    wide.mkdir()
    os.chmod(wide, 0o777)
    assert code(wide, "x", row) == "materialize.unsafe_parent" and code(tmp_path / "none", "x", row) == "materialize.io" and code(tmp_path, "../x", row) == "path.escape"
    assert code(tmp_path, "x", row, row | {"path": "l"}) == "materialize.unsafe_component"
    assert code(tmp_path, "x", row | {"sha256": "0"}) == "materialize.audit" and sorted(os.listdir(tmp_path)) == ["wide"]
    assert code(tmp_path, "x", row) is None
    stage = os.open(tmp_path / "x", os.O_RDONLY)
    os.symlink("/etc", tmp_path / "x/link")
    with pytest.raises(folder.Refused):
        folder.audit(stage, [row])
    os.close(stage)


def test_sources(spark, tmp_path):
    from quayside.sources.archives import requested, scan

    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.zip").write_bytes(TREE)
    (tmp_path / "in/deep/B.ZIP").write_bytes(b"x" * 5000)
    (tmp_path / "in/c.txt").write_bytes(b"no")
    base = f"file:{tmp_path}/in/"
    got = {r.archive_id.removeprefix(base): (r.length, r.content is None) for r in scan(spark, f"{tmp_path}/in", max_bytes=len(TREE)).collect()}
    assert got == {"a.zip": (len(TREE), False), "deep/B.ZIP": (5000, False)}
    got = {r.archive_id.removeprefix(base): (r.length, r.content is None) for r in scan(spark, f"{tmp_path}/in", max_bytes=4000).collect()}
    assert got == {"a.zip": (len(TREE), True), "deep/B.ZIP": (5000, True)}
    wanted = spark.createDataFrame([(base + x,) for x in ("a.zip", "gone.zip", "gone.zip")], "archive_id string")
    found = outcomes.inspect(requested(scan(spark, f"{tmp_path}/in"), wanted))
    assert sorted((r.archive_id.removeprefix(base), r.result) for r in found.collect()) == [("a.zip", "ALLOWED"), ("gone.zip", "source.io")]


def test_paths_below_a_folder(spark):
    from quayside.functions.jail import under

    rows = spark.createDataFrame([("a/b",), ("../x",), ("/x",), ("a//b",), ("",), (None,), ("a/.",)], "p string")
    got = [tuple(r.u) for r in rows.select(under("/d/", F.col("p")).alias("u")).collect()]
    assert got == [("/d/a/b", None)] + [(None, "path.escape")] * 6


def test_effects_and_the_registry(spark):
    answers = outcomes.inspect(table(spark, done=TREE, setup=TREE, late=TREE, bad=pack_bytes([("../x", b"x")])))
    report = spark.createDataFrame([("done", "committed", None), ("setup", "setup-failed", "materialize.exists"), ("late", "failed", "materialize.audit"), ("bad", "not-started", None)], "archive_id string, outcome string, code string")
    got = {r.archive_id: (r.effect, r.verdict, r.exit_code, r.verification, r.completeness, r.phase, r.wrote, r.admission) for r in outcomes.with_effect(answers, report).collect()}
    assert got == {
        "done": ("committed", "allowed", 0, "complete", "complete", None, True, "admitted"), "setup": ("failed", "rejected", 3, "structure-only", "partial", "effect", False, "admitted"),
        "late": ("failed", "rejected", 3, "complete", "complete", None, False, "admitted"), "bad": ("not-requested", "rejected", 2, "structure-only", "partial", "admission", False, "denied"),
    }
    told = {r.code: (r.phase, r.interpretation, r.admission) for r in outcomes.registry(spark).collect()}
    assert len(told) == sum(map(len, outcomes.CODES.values())) == 57
    assert told["quota.archive"] == ("source", "indeterminate", "denied") and told["covering.inconsistent"] == ("structure", "malformed", "denied") and told["materialize.io"] == ("effect", "interpreted", "admitted")


def test_command_line(spark, tmp_path, capsys):
    from quayside.__main__ import main

    os.chmod(tmp_path, 0o700)
    (tmp_path / "c/k").mkdir(parents=True)
    (tmp_path / "c/k/a.zip").write_bytes(TREE)
    (tmp_path / "c/k/b.zip").write_bytes(b"junk")
    assert main([f"{tmp_path}/c/k/a.zip", "--dest", f"{tmp_path}/out"], spark) == 0 and (tmp_path / "out/a/b.txt").read_bytes() == b"hello"
    out, err = capsys.readouterr()
    assert json.loads(out)["wrote"] is True and json.loads(err[err.index("{") :])["materialization"]["outcome"] == "committed"
    (tmp_path / "out/a/b.txt").write_bytes(b"else")
    assert main([f"{tmp_path}/c/k/a.zip", "--dest", f"{tmp_path}/out"], spark) == 3
    assert main([f"{tmp_path}/c/k/b.zip"], spark) == 2 and main([f"{tmp_path}/gone.zip"], spark) == 2
    capsys.readouterr()
    assert main(["--classify", f"{tmp_path}/c"], spark) == 0
    out = capsys.readouterr().out
    digest = re.search(r"corpus\tsha256\t([0-9a-f]{64})", out)[1]
    assert "k\tALLOWED\t1\t" in out and "k\tformat.unsupported\t1\t" in out
    good = f"total 2\ndigest sha256 {digest}\ncount k ALLOWED 1\ncount k format.unsupported 1\nallow k/a.zip\n"
    (tmp_path / "expect").write_text(good)
    assert main(["--classify", f"{tmp_path}/c", "--expect", f"{tmp_path}/expect"], spark) == 0
    (tmp_path / "expect").write_text(good.replace("k/a.zip", "k/b.zip"))
    assert main(["--classify", f"{tmp_path}/c", "--expect", f"{tmp_path}/expect"], spark) == 1


@pytest.fixture
def wide_batches(spark):
    """The session's bound on Arrow batches at Spark's default, whatever ran before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    yield
    spark.conf.set(name, before)


def test_python_holds_a_bounded_part_of_the_archives(spark, wide_batches):
    """18 MB of archives in one partition don't come to Python as one batch, as they would by the number of rows."""
    rows, size = 6000, 3000
    own = spark.range(rows, numPartitions=1).select(F.col("id").cast("string").alias("archive_id"), F.concat(F.lit("k/"), "id").alias("name"), F.repeat(F.lit("x"), size).cast("binary").alias("data"), F.lit(0).alias("kind"))

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    for frame in (fault_corpus(own), decode(fault_corpus(own), with_content=True), outcomes.inspected(fault_corpus(own), with_content=True)):
        got = frame.mapInArrow(measure, "n long, size long").collect()
        assert sum(r.n for r in got) == rows and max(r.size for r in got) < 6 << 20


def test_pieces_are_bounded_and_whole():
    import pyarrow as pa

    from quayside.sources.batches import PIECE_BYTES, PIECE_ROWS, pieces

    for n, size in ((0, 1), (1, 3 * PIECE_BYTES), (5, PIECE_BYTES), (3 * PIECE_ROWS + 1, 0), (3000, 2000)):
        whole = pa.RecordBatch.from_pydict({"k": list(range(n)), "c": pa.array([b"x" * size] * n, pa.binary())})
        cut = list(pieces([whole, whole]))
        assert [k for p in cut for k in p.column("k").to_pylist()] == [*range(n)] * 2
        assert all(0 < p.num_rows <= PIECE_ROWS and (p.num_rows == 1 or p.nbytes <= 1.1 * PIECE_BYTES) for p in cut)


def test_the_gate_inspects_a_corpus_once(spark):
    """Each archive goes through its three passes once, and paths that occur twice stay two rows."""
    from quayside.queries import expectation_diff

    plan = expectation_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow [^\n]*run\(", plan)) == 3
    found = spark.createDataFrame([("a/x", "a", "ALLOWED"), ("a/x", "a", "ALLOWED"), ("a/y", "a", "ALLOWED"), (None, "b", "ALLOWED")], "path string, class string, result string")
    got = sorted(map(tuple, gate.differences(found, gate.Expectations(4, "0" * 64, {("a", "ALLOWED"): 3}, frozenset(["a/y"]))).collect()), key=str)
    assert got == [("allow", "a/x", "rejected", "allowed")] * 2 + [("allow", None, "rejected", "allowed"), ("count", "b/ALLOWED", "0", "1")]
