"""Outcomes: one answer for each archive on five axes, and what a corpus of archives amounts to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quayside.operators import admission, structure, verification
from quayside.sources.archives import decode
from quayside.sources.batches import pieces

#: Codes of structural failures whose interpretation is not malformed, and of verification failures that make an archive malformed.
UNSUPPORTED = ("format.unsupported", "format.magic", "zip.diff.c5_zip64", "zip.encoding", "zip.encrypted", "method.unsupported")
QUOTAS = ("quota.files", "quota.metadata", "quota.overflow")
BROKEN_PAYLOAD = ("codec.deflate.invalid_stream", "codec.deflate.trailing_input", "zip.diff.c4_offset")


def axes(phase: Column, code: Column) -> dict[str, Column]:
    """Interpretation, admission, verification, completeness, verdict and exit code of an inspection that stopped in that phase (null: did not).

    A covering that its audit doesn't bear out is malformed and denied, whatever the phase.
    """
    ok = phase.isNull()
    interpretation = (
        F.when(ok | (phase == "admission") | code.isin(*QUOTAS), "interpreted").when(phase == "source", "indeterminate")
        .when((phase == "structure") & code.isin(*UNSUPPORTED), "unsupported").when((phase == "structure") | code.isin(*BROKEN_PAYLOAD), "malformed").otherwise("interpreted")
    )
    denied = (phase == "admission") | ((phase == "structure") & code.isin(*QUOTAS)) | ((phase == "verification") & ~code.isin(*BROKEN_PAYLOAD)) | ((phase == "source") & (code == "quota.archive"))
    inconsistent = F.coalesce(code == "covering.inconsistent", F.lit(False))
    interpretation, denied = F.when(inconsistent, "malformed").otherwise(interpretation), inconsistent | denied
    admitted = F.when(ok, "admitted").when(denied, "denied").otherwise("not-evaluated")
    return {
        "interpretation": interpretation, "admission": admitted, "verification": F.when(ok, "complete").when(phase == "verification", "partial").otherwise("structure-only"),
        "effect": F.lit("not-requested"), "completeness": F.when(ok, "complete").otherwise("partial"), "verdict": F.when(ok, "allowed").otherwise("rejected"), "exit_code": F.when(ok, 0).otherwise(2),
    }


MEMBER = "cd_index int, path string, is_dir boolean, method int, packed long, plain long, payload_offset long, size long, crc long, sha256 string, status string, code string"
INSPECTED = f"archive_id string, sha256 string, phase string, codes array<string>, members array<struct<{MEMBER.replace(' ', ':').replace(',:', ',')}>>"


def inspected(archives: DataFrame, caps: admission.Caps | None = None, *, max_bytes: int = 512 << 20, with_content: bool = False) -> DataFrame:
    """(archive_id, sha256, phase, codes, members) of ``archives`` (archive_id, length, content): one row each.

    phase: where it was stopped (source, structure, admission, verification; null: nowhere). codes: the findings there, in
    the order in which a scan makes them, repeated codes too. members: what verification got to know, in listing order;
    empty if an earlier phase stopped it, so rejected archives are never decompressed. Too long archives are
    quota.archive, others without content source.io. ``with_content`` keeps the content of archives that passed the first
    two phases.

    Plan: archives don't depend on each other, so all phases are projections and two passes over the rows of archives in
    place: no shuffle, no join, each archive's bytes are read once.
    """
    caps = caps or admission.Caps()
    own = archives.select("archive_id", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    decoded = decode(own, caps.max_files, with_content=True)
    source = F.when(F.col("length") > max_bytes, "quota.archive").when(F.col("content").isNull(), "source.io")
    broken = structure.first_failure(caps.max_files, caps.max_metadata_bytes)
    checked = decoded.select("archive_id", "sha256", "content", "entries", source.alias("source"), F.when(source.isNull(), broken).alias("structure"))
    sound = F.col("source").isNull() & F.col("structure").isNull()
    rows = checked.select("archive_id", "sha256", "source", "structure", F.when(sound, F.col("content")).alias("content"), F.when(sound, admission.plan(caps)).alias("plan"))
    arrow = to_arrow_schema(T.StructType.fromDDL(INSPECTED))

    def answer(row: dict) -> dict:
        out = {"archive_id": row["archive_id"], "sha256": row["sha256"], "members": []}
        for phase in ("source", "structure"):
            if row[phase]:
                return out | {"phase": phase, "codes": [row[phase]]}
        found = admission.scan(row["plan"], caps.max_total_bytes)
        if found:
            return out | {"phase": "admission", "codes": [code for _, code in found]}
        out["members"], code = verification.verified(row["content"], row["plan"])
        return out | {"phase": code and "verification", "codes": [code] if code else []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = pa.RecordBatch.from_pylist([answer(r) for r in batch.to_pylist()], schema=arrow)
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column("content")], names=[*arrow.names, "content"]) if with_content else out

    return rows.mapInArrow(run, INSPECTED + ", content binary" if with_content else INSPECTED)


def members_of(found: DataFrame) -> DataFrame:
    """A row for each member of ``inspected`` archives."""
    return found.select("archive_id", F.explode("members").alias("m")).select("archive_id", "m.*")


def judged(found: DataFrame) -> DataFrame:
    """``inspected`` archives with code (the first finding), result (ALLOWED, or all codes joined by +) and the axes."""
    named = found.withColumn("code", F.get("codes", F.lit(0))).withColumn("result", F.when(F.col("phase").isNull(), "ALLOWED").otherwise(F.array_join("codes", "+")))
    return named.select("*", *[c.alias(k) for k, c in axes(F.col("phase"), F.col("code")).items()])


def with_effect(answers: DataFrame, report: DataFrame) -> DataFrame:
    """``judged`` or ``inspect`` answers after publication was asked for: ``report`` has archive_id, outcome and code.

    Archives that weren't admitted keep their answer. Of the others, a committed one is allowed and written; else the
    effect has failed and the exit code is 3: in setup (setup-failed) nothing is verified any more and the phase is effect,
    after verification the view stays complete.
    """
    rows = answers.join(report.select("archive_id", F.col("outcome").alias("_outcome"), F.col("code").alias("_code")), "archive_id", "left")
    asked = F.col("phase").isNull() & F.col("_outcome").isNotNull()
    done, setup = asked & (F.col("_outcome") == "committed"), asked & (F.col("_outcome") == "setup-failed")
    failed = asked & (F.col("_outcome") != "committed")
    changed = {
        "wrote": F.coalesce(done, F.lit(False)), "effect": F.when(done, "committed").when(failed, "failed").otherwise(F.col("effect")),
        "verification": F.when(setup, "structure-only").otherwise(F.col("verification")), "completeness": F.when(setup, "partial").otherwise(F.col("completeness")),
        "verdict": F.when(failed, "rejected").otherwise(F.col("verdict")), "exit_code": F.when(failed, 3).otherwise(F.col("exit_code")),
        "code": F.when(failed, F.col("_code")).otherwise(F.col("code")), "result": F.when(failed, F.col("_code")).otherwise(F.col("result")), "phase": F.when(setup, "effect").otherwise(F.col("phase")),
    }
    return rows.withColumns(changed).drop("_outcome", "_code")


#: Every code, by the phase in which it is found first.
CODES = {
    "source": ["policy.unsupported", "quota.archive", "source.io"],
    "structure": [
        "format.unsupported", "format.magic", "quota.files", "quota.metadata", "quota.overflow", "zip.diff.a1_method", "zip.diff.a2_size", "zip.diff.a3_name", "zip.diff.a4_dir", "zip.diff.a5_crypt",
        "zip.diff.b2_chars", "zip.diff.c1_stream", "zip.diff.c2_eocd", "zip.diff.c3_count", "zip.diff.c4_offset", "zip.diff.c5_zip64", "zip.overlap", "zip.encoding", "zip.extra", "zip.flags", "covering.inconsistent",
    ],
    "admission": [
        "path.absolute", "path.dotdot", "path.empty", "path.ads", "path.reserved", "path.trailing", "path.escape", "path.depth", "path.nul", "path.invalid_char", "path.unicode", "path.case_fold", "path.conflict",
        "quota.member", "quota.total", "quota.ratio", "zip.diff.b1_dup", "zip.encrypted", "method.unsupported",
    ],
    "verification": ["quota.declared_lie", "codec.deflate.invalid_stream", "codec.deflate.trailing_input", "crc.mismatch"],
    "effect": [
        "materialize.exists", "materialize.io", "materialize.commit", "materialize.unsafe_parent", "materialize.unsafe_component", "materialize.cleanup", "materialize.unsupported",
        "materialize.unsupported_filesystem", "materialize.unsafe_stage", "materialize.audit",
    ],
}


def registry(spark: SparkSession) -> DataFrame:
    """(code, phase, interpretation, admission): every code and what an archive that is stopped by it is told."""
    rows = spark.createDataFrame([(code, phase) for phase, codes in CODES.items() for code in codes], "code string, phase string")
    told = axes(F.col("phase"), F.col("code"))
    effect, policy = F.col("phase") == "effect", F.col("code") == "policy.unsupported"
    return rows.select("code", "phase", F.when(effect, "interpreted").otherwise(told["interpretation"]).alias("interpretation"), F.when(effect, "admitted").when(policy, "denied").otherwise(told["admission"]).alias("admission"))


def inspect(archives: DataFrame, caps: admission.Caps | None = None, *, max_bytes: int = 512 << 20) -> DataFrame:
    """(archive_id, phase, code, result, and the axes) of ``archives`` (archive_id, length, content): one row each. See ``inspected``."""
    return judged(inspected(archives, caps, max_bytes=max_bytes)).drop("sha256", "codes", "members")


def corpus_counts(outcomes: DataFrame, group: Column) -> DataFrame:
    """(class, result, n, first): how many archives of each class came to each result, and the first of them."""
    return outcomes.groupBy(group.alias("class"), "result").agg(F.count(F.lit(1)).alias("n"), F.min("archive_id").alias("first"))


def corpus_gate(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(class, result, n, expected_n) where counts differ, either way; no row: the corpus is as expected."""
    both = actual.select("class", "result", "n").join(expected.select("class", "result", F.col("n").alias("expected_n")), ["class", "result"], "full_outer")
    return both.where(~F.col("n").eqNullSafe(F.col("expected_n")))
