"""A corpus of archives held against a written expectation."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_of(path: Column) -> Column:
    """The folder that the file is in; unknown where there is none."""
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit("unknown"))


@dataclass(frozen=True)
class Expectations:
    total: int
    digest: str
    counts: dict[tuple[str, str], int] = field(default_factory=dict)
    allowed: frozenset[str] = frozenset()


def read_expectations(text: str) -> Expectations:
    """The expectations written in ``text``, a line each: total N, digest sha256 HEX, count CLASS RESULT N, allow PATH.

    Blank lines and those that begin with # don't count. Raises ValueError for other lines, for what is said twice, and
    where counts don't sum up.
    """
    total = digest = None
    counts: dict[tuple[str, str], int] = {}
    allowed: set[str] = set()
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        kind, rest = words[0], words[1:]
        if kind == "total" and len(rest) == 1 and rest[0].isdecimal():
            again, total = total is not None, int(rest[0])
        elif kind == "digest" and len(rest) == 2 and rest[0] == "sha256" and re.fullmatch("[0-9A-Fa-f]{64}", rest[1]):
            again, digest = digest is not None, rest[1].lower()
        elif kind == "count" and len(rest) == 3 and rest[2].isdecimal():
            again = (rest[0], rest[1]) in counts
            counts[rest[0], rest[1]] = int(rest[2])
        elif kind == "allow" and len(rest) == 1:
            again = rest[0] in allowed
            allowed.add(rest[0])
        else:
            raise ValueError(f"line {number}: not a directive: {line.strip()}")
        if again:
            raise ValueError(f"line {number}: said before: {line.strip()}")
    if total is None or digest is None:
        raise ValueError("total or digest is missing")
    if sum(counts.values()) != total:
        raise ValueError(f"counts sum to {sum(counts.values())}, total is {total}")
    if len(allowed) != sum(n for (_, result), n in counts.items() if result == "ALLOWED"):
        raise ValueError(f"{len(allowed)} allowed paths don't match the ALLOWED counts")
    return Expectations(total, digest, counts, frozenset(allowed))


def corpus_digest(archives: DataFrame) -> str:
    """SHA-256 over all archives (path, length, sha256) in order of the paths' bytes: each path with its length, the size, the digest.

    One digest over an ordered whole can only be taken in order: some hundred bytes an archive are sorted by Spark and
    streamed to the driver, a partition at a time.
    """
    digest = hashlib.sha256()
    rows = archives.select(F.col("path").cast("binary").alias("path"), "length", F.unhex("sha256").alias("own")).orderBy("path")
    for r in rows.toLocalIterator():
        digest.update(struct.pack("<Q", len(r.path)) + bytes(r.path) + struct.pack("<Q", r.length) + bytes(r.own))
    return digest.hexdigest()


def differences(found: DataFrame, expected: Expectations, digest: str | None = None) -> DataFrame:
    """(kind, key, expected, actual) for everything in which ``found`` (path, class, result) isn't as expected.

    kind: total, digest (given the corpus's), count (key: class/result), allow (a path that should be and isn't allowed, or
    is and shouldn't be). No row: the corpus is as expected.

    Plan: ``found`` is evaluated once. Each of its rows gives a fact for every kind; facts are counted before they move,
    but for allowed paths, of which each stays a row, and meet what is expected in one equi-join.
    """
    spark = found.sparkSession
    said = [("total", "", str(expected.total)), *[("count", f"{c}/{r}", str(n)) for (c, r), n in expected.counts.items()], *[("allow", x, "allowed") for x in expected.allowed]]
    rows = found.select("path", F.concat_ws("/", "class", "result").alias("key"), "result", F.monotonically_increasing_id().alias("row"))
    fact = lambda kind, key, row: F.struct(kind.alias("kind"), key.alias("key"), row.cast("long").alias("row"))
    allowed = F.when(F.col("result") == "ALLOWED", fact(F.lit("allow"), F.col("path"), F.col("row")))
    each = rows.select(F.explode(F.array(fact(F.lit("total"), F.lit(""), F.lit(None)), fact(F.lit("count"), F.col("key"), F.lit(None)), allowed)).alias("fact")).where("fact IS NOT NULL")
    n = F.when(F.col("fact.kind") == "allow", "allowed").otherwise(F.count(F.lit(1)).cast("string"))
    actual = each.groupBy("fact").agg(n.alias("actual")).select("fact.kind", "fact.key", "actual")
    none = F.when(F.col("kind") == "allow", "rejected").otherwise("0")
    both = spark.createDataFrame(said, "kind string, key string, expected string").join(actual, ["kind", "key"], "full_outer")
    out = both.select("kind", "key", F.coalesce("expected", none).alias("expected"), F.coalesce("actual", none).alias("actual"))
    if digest is not None:
        out = out.union(spark.createDataFrame([("digest", "", expected.digest, digest)], "kind string, key string, expected string, actual string"))
    return out.where("expected != actual")
