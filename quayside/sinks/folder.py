"""Allowed archives published as folders: staged, audited, then renamed into place at once."""

from __future__ import annotations

import ctypes
import errno
import hashlib
import os
import secrets
import stat
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayside.operators import outcomes
from quayside.operators.verification import _pieces
from quayside.sources.batches import pieces

_DIRECTORY = os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW | os.O_CLOEXEC
_NEW_FILE = os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW | os.O_CLOEXEC
_NO_REPLACE = 1
REPORT = "archive_id string, outcome string, cleanup string, code string, published string, files long, bytes long"


class Refused(Exception):
    """A publication that stops; its one argument is the code."""


def trusted(parent: int) -> None:
    """Refuse a parent folder that others could change: owned by us or root; writable by others only with the sticky bit."""
    s = os.fstat(parent)
    if s.st_uid not in (os.geteuid(), 0) or (s.st_mode & 0o022 and not s.st_mode & stat.S_ISVTX):
        raise Refused("materialize.unsafe_parent")


def _below(folder: int, name: str) -> int:
    """The folder of that name in ``folder``, made if it isn't there; never through a link."""
    try:
        os.mkdir(name, 0o700, dir_fd=folder)
    except FileExistsError:
        pass
    try:
        return os.open(name, _DIRECTORY, dir_fd=folder)
    except OSError as e:
        raise Refused("materialize.unsafe_component") from e


def _place(stage: int, member: dict, content: bytes, sync: bool) -> None:
    """Write one member below the open folder ``stage``, step by step from folder to folder."""
    parts, held = member["path"].split("/"), [os.dup(stage)]
    try:
        for name in parts if member["is_dir"] else parts[:-1]:
            held.append(_below(held[-1], name))
        if not member["is_dir"]:
            try:
                file = os.open(parts[-1], _NEW_FILE, 0o600, dir_fd=held[-1])
            except OSError as e:
                raise Refused("materialize.unsafe_component") from e
            with os.fdopen(file, "wb") as out:
                at = member["payload_offset"]
                for piece in _pieces(content[at : at + member["packed"]], member["method"]):
                    out.write(piece)
                out.flush()
                if sync:
                    os.fsync(out.fileno())
        if sync:
            os.fsync(held[-1])
    finally:
        for x in held:
            os.close(x)


def _walk(folder: int, base: str = "") -> Iterator[tuple[str, int, str | None]]:
    """(path, size, sha256) of everything below the open folder; folders have no digest. Links and special files are refused."""
    for entry in sorted(os.listdir(folder)):
        s = os.stat(entry, dir_fd=folder, follow_symlinks=False)
        if stat.S_ISDIR(s.st_mode):
            yield base + entry, 0, None
            below = os.open(entry, _DIRECTORY, dir_fd=folder)
            try:
                yield from _walk(below, f"{base}{entry}/")
            finally:
                os.close(below)
        elif stat.S_ISREG(s.st_mode):
            digest = hashlib.sha256()
            with os.fdopen(os.open(entry, os.O_RDONLY | os.O_NOFOLLOW, dir_fd=folder), "rb") as data:
                while piece := data.read(64 << 10):
                    digest.update(piece)
            yield base + entry, s.st_size, digest.hexdigest()
        else:
            raise Refused("materialize.audit")


def audit(stage: int, members: list[dict]) -> None:
    """Refuse a stage that doesn't hold exactly the members, with their sizes and digests, and the folders above them."""
    want: dict[str, tuple[int, str | None]] = {}
    for m in members:
        parts = m["path"].split("/")
        want |= {"/".join(parts[:k]): (0, None) for k in range(1, len(parts))}
        want[m["path"]] = (0, None) if m["is_dir"] else (m["size"], m["sha256"])
    if {path: (size, digest) for path, size, digest in _walk(stage)} != want:
        raise Refused("materialize.audit")


def _removed(parent: int, name: str) -> str:
    """Delete the stage; tried twice. removed, or failed."""
    import shutil

    for _ in range(2):
        try:
            shutil.rmtree(name, dir_fd=parent)
            return "removed"
        except OSError:
            continue
    return "failed"


def _rename(parent: int, stage: str, name: str) -> None:
    """Give the stage its name, unless that is taken: in one step of the file system, which never replaces."""
    call = getattr(ctypes.CDLL(None, use_errno=True), "renameat2", None)
    if call is None:
        raise Refused("materialize.unsupported")
    if call(parent, os.fsencode(stage), parent, os.fsencode(name), _NO_REPLACE):
        raise Refused("materialize.exists" if ctypes.get_errno() in (errno.EEXIST, errno.ENOTEMPTY) else "materialize.commit")


def _committed(parent: str, name: str, members: list[dict]) -> dict:
    return {"outcome": "committed", "cleanup": "not-needed", "published": f"{parent.rstrip('/')}/{name}", "files": sum(not m["is_dir"] for m in members), "bytes": sum(m["size"] for m in members)}


def publish_one(parent_path: str, name: str, members: list[dict], content: bytes, sync: bool) -> dict:
    """Publish one verified archive as ``name`` below the parent; what came of it."""
    report = {"outcome": "setup-failed", "cleanup": "not-created", "code": None, "published": None, "files": 0, "bytes": 0}
    try:
        parent = os.open(parent_path, _DIRECTORY)
    except OSError:
        return report | {"code": "materialize.io"}
    stage = None
    try:
        trusted(parent)
        if name in ("", ".", "..") or "/" in name or "\0" in name:
            raise Refused("path.escape")
        if name in os.listdir(parent):
            raise Refused("materialize.exists")
        for _ in range(128):
            stage = f".stage-{secrets.token_hex(16)}"
            try:
                os.mkdir(stage, 0o700, dir_fd=parent)
                break
            except FileExistsError:
                stage = None
        if stage is None:
            raise Refused("materialize.io")
        report["outcome"] = "failed"
        folder = os.open(stage, _DIRECTORY, dir_fd=parent)
        try:
            for m in members:
                _place(folder, m, content, sync)
            audit(folder, members)
        finally:
            os.close(folder)
        _rename(parent, stage, name)
        if sync:
            os.fsync(parent)
        return report | _committed(parent_path, name, members)
    except Refused as e:
        report["code"] = e.args[0]
    except (OSError, zlib.error, EOFError):
        report["code"] = "materialize.io"
    finally:
        if stage and report["code"] and report["outcome"] != "setup-failed":
            report["cleanup"] = _removed(parent, stage)
        os.close(parent)
    if report["cleanup"] == "failed":
        report["code"] += "+materialize.cleanup"
    return report


def publish(archives: DataFrame, parent: str, caps=None, *, name: str = "sha2(archive_id, 256)", sync: bool = False, max_bytes: int = 512 << 20) -> DataFrame:
    """(archive_id, outcome, cleanup, code, published, files, bytes) of ``archives`` (archive_id, length, content).

    Each archive that is allowed becomes the folder ``name`` (a SQL expression) below ``parent``, a folder on a file system
    that all executors share. It is staged under a random name, audited against what verification found, and renamed at
    once: a reader sees it whole or not at all, and nothing is ever replaced. Others are not-started. ``sync`` writes
    through to the disk. A task that runs again finds the folder there: materialize.exists, unless what is there is
    the same, which counts as committed. So lost executors leave at most a stage that nobody reads.

    Publishing is an effect: write or cache the report, don't evaluate it twice for its own sake.
    """
    found = outcomes.inspected(archives, caps, max_bytes=max_bytes, with_content=True)
    rows = found.select("archive_id", F.when(F.col("phase").isNull(), F.col("content")).alias("content"), F.expr(name).alias("name"), F.when(F.col("phase").isNull(), F.col("members")).alias("members"))

    def answer(row: dict) -> dict:
        if row["members"] is None:
            return {"archive_id": row["archive_id"], "outcome": "not-started", "cleanup": "not-created", "files": 0, "bytes": 0}
        report = publish_one(parent, row["name"], row["members"], row["content"], sync)
        if report["code"] == "materialize.exists" and _same(parent, row["name"], row["members"]):
            report |= _committed(parent, row["name"], row["members"]) | {"code": None}
        return {"archive_id": row["archive_id"]} | report

    arrow = to_arrow_schema(StructType.fromDDL(REPORT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_pylist([answer(r) for r in batch.to_pylist()], schema=arrow)

    return rows.mapInArrow(run, REPORT)


def _same(parent: str, name: str, members: list[dict]) -> bool:
    """Whether the folder that is there already holds exactly these members."""
    try:
        above = os.open(parent, _DIRECTORY)
        try:
            folder = os.open(name, _DIRECTORY, dir_fd=above)
        finally:
            os.close(above)
        try:
            audit(folder, members)
        finally:
            os.close(folder)
    except (Refused, OSError):
        return False
    return True
