"""URL filters: a blocked Bloom filter of listed canonical URLs, and an exact join of what passes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is so many words of 32 bits; a key sets one bit of each.
WORDS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int") for k in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of ``keys`` (key): the words of every block that has a key."""
    one = F.lit(1).cast("long")
    masks = [F.call_function("shiftleft", one, b).alias(f"w{k}") for k, b in enumerate(_bits(F.col("key")))]
    return keys.select(_block(F.col("key"), blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", filter_bytes: int = 64 << 20, max_path_lengths: int = 4096) -> DataFrame:
    """``pages`` (url, any more) with host, path, rule and verdict; columns of these names are replaced.

    ``rules``: (host, path, verdict), verdict allow or block. A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest (host and path together, then host) wins; of equal rules block wins. Rules
    with an empty or null host don't count. Urls that no rule fits get ``default`` and a null rule; so do a null url
    and one without ``://``, whose host and path are empty.

    Plan: the distinct (host, path) give a key for each suffix of the host and each length that rules' paths have
    (beyond ``max_path_lengths`` of them: each length up to the longest). A filter of at most ``filter_bytes`` goes to
    all tasks and drops most keys; the rest meet the rules in an exact join. More rules than the filter has room for
    let more keys pass, nothing else.
    """
    listed = rules.where("host != ''").select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    listed = listed.select(F.concat("rule_host", "rule_path").alias("key"), "rule_host", "rule_path", "verdict")
    listed = listed.groupBy("key", "rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().limit(max_path_lengths + 1).collect())
    if len(lengths) <= max_path_lengths:
        steps = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    else:
        steps = F.sequence(F.lit(0), F.least(F.length("path"), F.lit(listed.agg(F.max(F.length("rule_path"))).first()[0])))
    blocks = max(1, min(filter_bytes // (8 * WORDS + 8), listed.count() * 16 // (32 * WORDS) + 1))
    names = ("host", "path", "rule", "verdict")
    urls = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in names], host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))

    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    keys = urls.select("host", "path").distinct().select("host", "path", F.explode(steps).alias("n"))
    keys = keys.select("host", "path", "n", F.explode(suffixes).alias("suffix")).select("host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("n"))).alias("key"))
    passed = keys.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(blocked_bloom(listed.select("key"), blocks)), "block")
    for k, bit in enumerate(_bits(F.col("key"))):
        passed = passed.where(F.call_function("shiftrightunsigned", F.col(f"w{k}"), bit).bitwiseAND(F.lit(1)) == 1)
    best = F.max(F.struct(F.length("key").alias("n"), F.length("rule_host").alias("h"), "verdict", F.col("key").alias("rule")))
    found = passed.select("host", "path", "key").join(listed, "key").groupBy("host", "path").agg(best.alias("best"))
    out = urls.join(found, ["host", "path"], "left")
    plain = [F.col(f"`{c}`") for c in urls.columns if c not in names]
    return out.select(*plain, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, q, v) AS (VALUES {_RULE_ROWS}),
fit AS (SELECT r, arg_max(h || q, length(h) + length(q)) AS rule, arg_max(v, length(h) + length(q)) AS v
        FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fit USING (r)
"""
