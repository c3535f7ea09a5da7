"""Inspections as documents: the view of an archive and the receipt of its inspection, as compact JSON columns."""

from __future__ import annotations

import platform

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators import outcomes
from quayside.operators.policy import Policy


def member_views(phase: Column, members: Column) -> Column:
    """The verified members' views: in order of paths if all are verified, else in listing order. Directories have no bytes and are stored."""
    done = F.filter(members, lambda m: m["status"] == "verified")

    def view(m: Column) -> Column:
        is_dir, method = m["is_dir"], F.when(m["is_dir"] | (m["method"] == 0), "store").otherwise("deflate")
        return F.struct(
            m["path"].alias("path"), F.when(is_dir, "dir").otherwise("file").alias("kind"), F.when(is_dir, F.lit(0)).otherwise(m["packed"]).cast("long").alias("comp_bytes"), m["size"].alias("uncomp_bytes"),
            method.alias("method"), F.lpad(F.lower(F.hex(m["crc"])), 8, "0").alias("crc32"), m["sha256"].alias("sha256"),
        )

    views = F.transform(done, view)
    return F.when(phase.isNull(), F.array_sort(views)).otherwise(views)


def _status(value: Column, **more: Column) -> Column:
    return F.struct(value.alias("status"), *[v.alias(k) for k, v in more.items()])


def documents(found: DataFrame, policy: Policy | None = None, *, schema: str = "quayside", path: Column | None = None) -> DataFrame:
    """(archive_id, view, receipt, view_sha256) of ``outcomes.inspected`` archives; view and receipt are compact JSON.

    A policy that isn't supported gives every archive the same answer, policy.unsupported, whatever was found.
    """
    policy = policy or Policy()
    rows = outcomes.judged(found)
    if policy.unsupported():
        stop = {"phase": "source", "code": "policy.unsupported", "interpretation": "indeterminate", "admission": "denied", "verification": "structure-only", "effect": "not-requested", "completeness": "partial", "verdict": "rejected"}
        rows = rows.withColumns({k: F.lit(v) for k, v in stop.items()} | {"codes": F.array(F.lit("policy.unsupported")), "members": F.slice("members", 1, 0), "exit_code": F.lit(2)})
    count = lambda status: F.size(F.filter("members", lambda m: m["status"] == status)).cast("long")
    part = F.col("verification") == "partial"
    shared = {
        "interpretation": _status(F.col("interpretation")), "admission": _status(F.col("admission")),
        "verification": _status(F.col("verification"), verified_members=F.when(part, count("verified")), pending_members=F.when(part, F.size("members") - count("verified")).cast("long")),
        "effect": _status(F.col("effect")), "view_completeness": _status(F.col("completeness"), phase=F.col("phase"), cause=F.col("code")),
    }
    axes = [v.alias(k) for k, v in shared.items()]
    source = F.struct((F.col("archive_id") if path is None else path).alias("path"), F.struct(F.col("sha256").alias("sha256")).alias("digest"))
    own = F.struct(F.lit(policy.id).alias("id"), F.struct(F.lit(policy.digest()).alias("sha256")).alias("digest"))
    codes = F.transform("codes", lambda c: F.struct(c.alias("code"), F.lit("error").alias("severity")))
    view = F.to_json(F.struct(F.lit(f"{schema}.view.v1").alias("schema"), source.alias("source"), own.alias("policy"), *axes, F.col("verdict").alias("verdict"), F.lit(False).alias("wrote"), codes.alias("findings"), member_views(F.col("phase"), F.col("members")).alias("members")))
    rows = rows.withColumn("view", view).withColumn("view_sha256", F.sha2("view", 256))
    place = F.struct(F.lit(platform.system().lower()).alias("os"), F.lit(platform.machine()).alias("arch"))
    receipt = F.to_json(F.struct(F.lit(f"{schema}.receipt.v2").alias("schema"), F.col("verdict").alias("verdict"), F.lit(False).alias("wrote"), *axes, source.alias("source"), own.alias("policy"), F.struct(F.col("view_sha256").alias("sha256")).alias("view_digest"), place.alias("environment"), F.lit(False).alias("signed"), codes.alias("findings")))
    return rows.select("archive_id", "view", receipt.alias("receipt"), "view_sha256")
