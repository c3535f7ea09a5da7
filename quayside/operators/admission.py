"""Admission checks of members: quotas, path rules, repeated paths and paths that run through a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.jail import canonical, path_code, ratio_exceeds
from quayside.operators.structure import decoded_name


@dataclass(frozen=True)
class Caps:
    """Limits of one archive; ``max_ratio`` None turns that check off."""

    max_files: int = 10_000
    max_member_bytes: int = 1 << 30
    max_total_bytes: int = 5 << 30
    max_ratio: int | None = 100
    max_path_depth: int = 32
    max_metadata_bytes: int = 4 << 20


def plan(caps: Caps) -> Column:
    """For each entry of a decoded archive, in order: what the sequential scan needs (see ``scan``), path null where a rule is broken."""

    def member(e: Column) -> Column:
        name = decoded_name(e)
        stripped = F.regexp_replace(name, r"/\z", "")
        own = (
            F.when(e["flags"].bitwiseAND(1) != 0, "zip.encrypted").when(~e["method"].isin(0, 8), "method.unsupported").when(e["plain"] > caps.max_member_bytes, "quota.member")
            .when(ratio_exceeds(e["plain"], e["packed"], F.lit(caps.max_ratio).cast("long")), "quota.ratio")
        )
        jail = path_code(stripped, caps.max_path_depth)
        fields = ("cd_index", "method", "packed", "plain", "crc", "payload_offset")
        return F.struct(*[e[x].alias(x) for x in fields], F.endswith(name, F.lit("/")).alias("is_dir"), F.when(jail.isNull(), canonical(stripped)).alias("path"), own.alias("own"), jail.alias("jail"))

    return F.transform("entries", member)


def with_paths(entries: DataFrame, max_depth: int = 32) -> DataFrame:
    """``entries`` with is_dir and the canonical path, null where a path rule is broken."""
    raw = decoded_name()
    stripped = F.regexp_replace(raw, r"/\z", "")
    return entries.withColumn("is_dir", F.endswith(raw, F.lit("/"))).withColumn("path", F.when(path_code(stripped, max_depth).isNull(), canonical(stripped)))


def scan(members: list[dict], max_total: int) -> list[tuple[int, str]]:
    """(cd_index, code) of the findings in the order in which a scan of one archive makes them.

    Each member is compared with those accepted before it; the first that breaks the running total ends the scan. This is
    a fold over one archive's members, of which there are at most ``max_files``.
    """
    found: list[tuple[int, str]] = []
    total = 0
    exact, folded = _Accepted(), _Accepted()
    for m in members:
        code = m["own"]
        if code is None:
            total += m["plain"]
            if total > max_total:
                found.append((m["cd_index"], "quota.total"))
                break
            path, code = m["path"], m["jail"]
            if code is None:
                low = path.lower()
                code = "zip.diff.b1_dup" if path in exact.kinds else "path.case_fold" if low in folded.kinds else None
                code = code or ("path.conflict" if exact.conflicts(path, m["is_dir"]) else "path.case_fold" if folded.conflicts(low, m["is_dir"]) else None)
            if code is None:
                exact.add(path, m["is_dir"])
                folded.add(low, m["is_dir"])
        if code is not None:
            found.append((m["cd_index"], code))
    return found


class _Accepted:
    """Accepted paths, and all folders above them."""

    def __init__(self) -> None:
        self.kinds: dict[str, bool] = {}
        self.above: set[str] = set()

    def _up(self, path: str) -> list[str]:
        return [path[:k] for k, sign in enumerate(path) if sign == "/"]

    def conflicts(self, path: str, is_dir: bool) -> bool:
        return any(self.kinds.get(x) is False for x in self._up(path)) or (not is_dir and path in self.above)

    def add(self, path: str, is_dir: bool) -> None:
        self.kinds[path] = is_dir
        self.above.update(self._up(path))


def judged_members(members: DataFrame, caps: Caps) -> DataFrame:
    """``members`` (archive_id, cd_index, raw, flags, method, packed, plain) with path and code (null: nothing found yet).

    Running totals count members that pass the checks before; nothing is looked at behind the first that breaks the total.
    """
    stripped = F.regexp_replace("raw", r"/\z", "")
    own = (
        F.when(F.col("flags").bitwiseAND(1) != 0, "zip.encrypted")
        .when(~F.col("method").isin(0, 8), "method.unsupported")
        .when(F.col("plain") > caps.max_member_bytes, "quota.member")
        .when(ratio_exceeds(F.col("plain"), F.col("packed"), F.lit(caps.max_ratio).cast("long")), "quota.ratio")
    )
    order = Window.partitionBy("archive_id").orderBy("cd_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = members.withColumn("own", own).withColumn("total", F.sum(F.when(F.col("own").isNull(), F.col("plain"))).over(order))
    over = F.when(F.col("own").isNull() & (F.col("total") > caps.max_total_bytes), F.col("cd_index"))
    cut = counted.withColumn("stop", F.min(over).over(Window.partitionBy("archive_id"))).where("stop IS NULL OR cd_index <= stop")
    code = F.coalesce("own", F.when(F.col("cd_index") == F.col("stop"), "quota.total"), path_code(stripped, caps.max_path_depth))
    return cut.select("archive_id", "cd_index", "plain", F.endswith("raw", F.lit("/")).alias("is_dir"), canonical(stripped).alias("path"), code.alias("code"))


def repeated_paths(members: DataFrame) -> DataFrame:
    """(archive_id, cd_index, code) of members whose path, or its lower case, an earlier member has."""
    by_path = Window.partitionBy("archive_id", "path").orderBy("cd_index")
    by_fold = Window.partitionBy("archive_id", F.lower("path")).orderBy("cd_index")
    ranked = members.select("archive_id", "cd_index", F.row_number().over(by_path).alias("a"), F.row_number().over(by_fold).alias("b"))
    return ranked.select("archive_id", "cd_index", F.when(F.col("a") > 1, "zip.diff.b1_dup").when(F.col("b") > 1, "path.case_fold").alias("code")).where("code IS NOT NULL")


def ancestor_conflicts(members: DataFrame) -> DataFrame:
    """(archive_id, cd_index, code) of members below a path that is a file: an equi-join of ancestors with files."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    below = members.where(F.contains("path", F.lit("/"))).select("archive_id", "cd_index", F.explode(above).alias("up"))
    files = members.where("NOT is_dir").select("archive_id", F.col("path").alias("up"))
    exact = below.join(files, ["archive_id", "up"], "left_semi").select("archive_id", "cd_index", F.lit("path.conflict").alias("code"))
    lower = below.withColumn("up", F.lower("up")).join(files.withColumn("up", F.lower("up")), ["archive_id", "up"], "left_semi").select("archive_id", "cd_index", F.lit("path.case_fold").alias("code"))
    return exact.union(lower).groupBy("archive_id", "cd_index").agg(F.max("code").alias("code"))


def findings(members: DataFrame, caps: Caps | None = None) -> DataFrame:
    """(archive_id, cd_index, code): each member's first admission finding.

    The verdict of an archive is that of a scan that compares each member with the accepted ones before it: where any
    two members clash, one of them has a finding either way.
    """
    judged = judged_members(members, caps or Caps())
    clean = judged.where("code IS NULL")
    found = judged.where("code IS NOT NULL").select("archive_id", "cd_index", "code", F.lit(0).alias("rank"))
    found = found.union(repeated_paths(clean).withColumn("rank", F.lit(1))).union(ancestor_conflicts(clean).withColumn("rank", F.lit(2)))
    return found.groupBy("archive_id", "cd_index").agg(F.min_by("code", "rank").alias("code"))
