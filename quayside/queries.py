"""The registered queries of the admission operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions.jail import RESERVED, canonical, path_code, ratio_exceeds
from quayside.operators import admission, covering, documents, gate, outcomes, roots, structure, verification
from quayside.sources.archives import decode, pack
from quayside.sources.faults import KINDS, fault_corpus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of every source's bytes."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each document: its path is source/lang/doc_id.txt."""
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return pack(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("archive_id"), F.lit(0).alias("seq"), name.alias("name"), F.col("text").cast("binary").alias("data")))


def members_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored members of packed archives that are allowed, read from the archive's bytes."""
    found = outcomes.members_of(outcomes.inspected(_packed(spark, sf_dir)).where("phase IS NULL")).where("method = 0")
    return found.select("path", F.col("size").alias("uncomp_bytes"), "sha256", (F.col("status") == "verified").alias("crc_ok"))


def path_jail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path rules over page addresses without their scheme."""
    raw = F.regexp_replace("url", "^[a-z]+://", "")
    return _table(spark, sf_dir, "pages").select("page_id", path_code(raw).alias("code"), F.when(path_code(raw).isNull(), canonical(raw)).alias("path"))


def quota_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact ratio check over pairs of sizes."""
    plain, packed = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ratio_exceeds(plain, packed, F.lit(100).cast("long")).alias("exceeds"))


def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose path, or its lower case, an earlier member of the brand has."""
    members = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("archive_id"), F.col("p_partkey").alias("cd_index"), F.col("p_name").alias("path"))
    return admission.repeated_paths(members)


def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and bytes of each source's packed archives, by their decoded entries."""
    source = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("archive_id"), "source").distinct()
    each = structure.entries(decode(_packed(spark, sf_dir))).join(source, "archive_id")
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("members"), F.sum("plain").alias("bytes"))


def _compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deflated archive for each document; in German, its path is absolute."""
    name = F.concat(F.when(F.col("lang") == "de", "/").otherwise(""), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return pack(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("archive_id"), F.lit(0).alias("seq"), name.alias("name"), F.col("text").cast("binary").alias("data")), deflate=True)


def verified_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of the compressed archives, decoded and compared with its record."""
    archives = _compressed(spark, sf_dir)
    return verification.verify(archives, structure.entries(decode(archives))).select("archive_id", "cd_index", "size", "sha256", "status", "code")


def archive_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer for each compressed archive."""
    return outcomes.inspect(_compressed(spark, sf_dir)).select("archive_id", "phase", "code", "result", "interpretation", "admission", "verification", "verdict", "exit_code")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("archive_id"), "source")
    return outcomes.corpus_counts(outcomes.inspect(_compressed(spark, sf_dir)).join(source, "archive_id"), F.col("source"))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many compressed archives of each source come to each result."""
    return _classified(spark, sf_dir)


def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where those counts differ from the expectation that all archives are allowed."""
    expected = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("result", F.lit("ALLOWED"))
    return outcomes.corpus_gate(_classified(spark, sf_dir), expected)


def covering_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the ranges that decoding claims; by doc_id modulo 5, a claim is wrong: the digest, the number of members, a record's end, an offset."""
    archives = _compressed(spark, sf_dir)
    decoded = decode(archives)
    k = F.pmod(F.col("archive_id").cast("long"), F.lit(5))
    more = lambda n, name: F.col(name) + F.when(k == n, 1).otherwise(0)
    claims = decoded.select("archive_id", F.when(k == 1, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"), "cd_offset", "cd_size", "end_offset", F.octet_length("comment").alias("comment_size"), more(2, "total_count").alias("count"))
    members = structure.entries(decoded).withColumn("record_end", more(3, "record_end")).withColumn("cdh_offset", more(4, "cdh_offset"))
    return covering.audit(archives, claims, members)


def content_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content digest of each packed archive."""
    return roots.content_roots(outcomes.members_of(outcomes.inspected(_packed(spark, sf_dir))))


def layout_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout digest of each packed archive."""
    decoded = decode(_packed(spark, sf_dir))
    members = admission.with_paths(structure.entries(decoded)).where("path IS NOT NULL")
    return roots.layout_roots(decoded, members)


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each document, its fault by doc_id modulo the number of kinds."""
    docs = _table(spark, sf_dir, "documents").where("octet_length(text) > 0")
    name = F.concat_ws("/", F.lit("k"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return fault_corpus(docs.select(F.col("doc_id").cast("string").alias("archive_id"), name.alias("name"), F.col("text").cast("binary").alias("data"), F.pmod("doc_id", F.lit(len(KINDS))).alias("kind")))


def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first structural check that each archive with an injected fault fails; null where it fails none."""
    return decode(_faulty(spark, sf_dir).where("content IS NOT NULL")).select("archive_id", structure.first_failure().alias("code"))


def verdict_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers for archives with injected faults, on all axes."""
    return outcomes.inspect(_faulty(spark, sf_dir)).select("archive_id", "phase", "code", "result", "interpretation", "admission", "verification", "effect", "completeness", "verdict")


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many archives with injected faults end with each exit code."""
    return outcomes.inspect(_faulty(spark, sf_dir)).groupBy("exit_code").agg(F.count(F.lit(1)).alias("n"))


def _fault_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("corpus/kind"), F.pmod(F.col("archive_id").cast("long"), F.lit(len(KINDS))).cast("string"), F.lit("/"), "archive_id", F.lit(".zip"))
    return outcomes.inspect(_faulty(spark, sf_dir)).withColumn("path", path).withColumn("class", gate.class_of(F.col("path")))


def fault_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many archives of each class (the folder they are in) come to each result, and the first of them."""
    return outcomes.corpus_counts(_fault_classes(spark, sf_dir), F.col("class"))


def expectation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where archives with injected faults differ from an expectation that says ten of kind 0 are allowed, five of kind 1 aren't, and no more."""
    allowed = [f"allow corpus/kind0/{len(KINDS) * k}.zip" for k in range(10)]
    text = "\n".join(["# written by hand", "total 15", "digest sha256 " + "0" * 64, "count kind0 ALLOWED 10", "count kind1 format.unsupported 5", *allowed])
    return gate.differences(_fault_classes(spark, sf_dir), gate.read_expectations(text))


def finding_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of archives of ten documents each, whose paths break rules or clash with those before, in order."""
    names = F.array(*[F.lit(x) for x in ("a/b", "../up", "A/B", "xx:y", "a/b", "a", "../up", "c./d", "ok/", "a/b/c")])
    docs = _table(spark, sf_dir, "documents")
    member = docs.select((F.floor(F.col("doc_id") / 10)).cast("string").alias("archive_id"), F.pmod("doc_id", F.lit(10)).cast("int").alias("seq"), F.col("text").cast("binary").alias("data"))
    named = member.select("archive_id", "seq", F.get(names, F.col("seq")).alias("name"), F.when(F.col("seq") == 8, F.lit(b"")).otherwise(F.col("data")).alias("data"))
    named = named.where("seq != 8")  # a directory's attributes must say so, which plain packing doesn't
    return outcomes.inspect(pack(named)).select("archive_id", "phase", "result")


def quota_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member with which each order's line prices, taken for sizes, go over the total."""
    members = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_partkey").cast("long")).alias("plain"))
    rows = members.select(F.col("l_orderkey").cast("string").alias("archive_id"), F.col("l_linenumber").cast("int").alias("cd_index"), F.lit("a").alias("raw"), F.lit(0).alias("flags"), F.lit(0).alias("method"), F.col("plain").alias("packed"), "plain")
    top = admission.Caps(max_total_bytes=3000, max_member_bytes=1800)
    return admission.judged_members(rows, top).where("code IS NOT NULL").select("archive_id", "cd_index", "code")


def ancestor_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each language whose path runs through a file of it: every fifth document is a file where others have a folder."""
    docs = _table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), (F.floor(F.col("doc_id") / 5) % 7).cast("string"))
    path = F.when(F.col("doc_id") % 5 == 0, folder).otherwise(F.concat_ws("/", folder, F.col("doc_id").cast("string")))
    return admission.ancestor_conflicts(docs.select(F.col("lang").alias("archive_id"), F.col("doc_id").alias("cd_index"), path.alias("path"), F.lit(False).alias("is_dir")))


def layout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each source's documents, laid end to end by their lengths: some begin late, some end late."""
    docs = _table(spark, sf_dir, "documents").where("n_chars > 8")
    order = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum("n_chars").over(order)
    rows = docs.select(F.col("source").alias("archive_id"), F.col("doc_id").alias("cd_index"), (stop - F.col("n_chars") + F.when(F.col("doc_id") % 97 == 0, 1).otherwise(0)).alias("start"), (stop + F.when(F.col("doc_id") % 89 == 0, 1).otherwise(0)).alias("stop"), F.sum("n_chars").over(Window.partitionBy("source")).alias("limit"))
    return structure.layout_codes(rows)


def cdh_lfh_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second record of a line says differently from the first: faults by order key."""
    k = F.col("l_orderkey")
    off = lambda of, by=1: F.when(k % of == 0, F.lit(by)).otherwise(F.lit(0)).cast("long")
    name, size, crc = F.col("l_linenumber").cast("string").cast("binary"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")
    fields = {
        "fixed": F.lit(True), "ok": F.lit(True), "lfh_in": F.lit(True), "lfh_ok": F.lit(True), "extra_bad": F.lit(False), "lfh_extra_bad": F.lit(False), "extras": F.array().cast("array<struct<site:int,id:int,at:long,size:int>>"), "comment": F.lit(b""),
        "name": name, "lfh_name": F.when(k % 11 == 0, F.lit(b"other")).otherwise(name), "method": F.lit(0), "lfh_method": off(13, 8).cast("int"), "flags": F.lit(0), "lfh_flags": (off(7, 1) + off(5, 2)).cast("int"),
        "packed": size, "lfh_packed": size + off(3), "plain": size, "lfh_plain": size, "crc": crc, "lfh_crc": crc + off(17), "lfh_offset": F.lit(0).cast("long"), "attributes": F.lit(0).cast("long"), "payload_in": F.lit(True), "payload_signed": F.lit(False), "descriptor_in": F.lit(True), "descriptor_ok": F.lit(True), "metadata": F.lit(0).cast("long"),
    }
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(*[v.alias(n) for n, v in fields.items()]).alias("e"))
    return rows.select("l_orderkey", "l_linenumber", structure.member_code(F.col("e")).alias("code"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all packed archives: their verdicts and members, read back from the JSON."""
    made = documents.documents(outcomes.inspected(_packed(spark, sf_dir)))
    read = F.from_json("view", "verdict string, members array<struct<path:string,kind:string,comp_bytes:long,uncomp_bytes:long,method:string,crc32:string,sha256:string>>")
    one = made.select("archive_id", read.alias("v")).select("archive_id", "v.verdict", F.explode("v.members").alias("m"))
    return one.select("archive_id", "verdict", "m.path", "m.kind", "m.comp_bytes", "m.uncomp_bytes", "m.method", "m.sha256")


def _le(number: str, width: int) -> str:
    """SQL for the hex of a number's lowest bytes, the lowest first."""
    return "(" + " || ".join(f"printf('%02X', ({number} >> {8 * k}) & 255)" for k in range(width)) + ")"


def _of_kinds(select: str) -> str:
    """SQL over a (doc_id, kind, phase, code): the documents with the stop that their fault leads to."""
    quoted = lambda x: f"'{x}'" if x else "NULL"
    kinds = ", ".join(f"({k}, {quoted(phase)}, {quoted(code)})" for k, (_, phase, code) in enumerate(KINDS))
    return f"WITH k(kind, phase, code) AS (VALUES {kinds}), a AS (SELECT doc_id, k.* FROM documents JOIN k ON doc_id % {len(KINDS)} = k.kind WHERE octet_length(encode(text)) > 0) {select}"


FLAGSHIP = members_inventory
QUERIES = {f.__name__: f for f in (source_digest, members_inventory, path_jail, quota_ratio, duplicate_paths, archive_summary, verified_members, archive_outcomes, corpus_counts, corpus_gate, covering_audit, content_root, layout_root, first_failure, verdict_axes, exit_codes, fault_counts, expectation_diff, finding_sequence, quota_total, ancestor_conflicts, layout_gaps, cdh_lfh_agreement, views)}
SQL = {
    "source_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "members_inventory": "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS uncomp_bytes, sha256(text) AS sha256, true AS crc_ok FROM documents",
    "quota_ratio": "SELECT l_orderkey, l_linenumber, l_partkey::HUGEINT > 100 * l_linenumber::HUGEINT AS exceeds FROM lineitem",
    "duplicate_paths": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS a, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS b FROM part)
SELECT p_brand AS archive_id, p_partkey AS cd_index, CASE WHEN a > 1 THEN 'zip.diff.b1_dup' ELSE 'path.case_fold' END AS code FROM r WHERE a > 1 OR b > 1""",
    "archive_summary": "SELECT source, count(*) AS members, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source",
    "verified_members": "SELECT doc_id::VARCHAR AS archive_id, 0::INTEGER AS cd_index, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256, 'verified' AS status, NULL::VARCHAR AS code FROM documents",
    "covering_audit": "SELECT doc_id::VARCHAR AS archive_id, CASE WHEN doc_id % 5 <> 0 THEN 'covering.inconsistent' END AS code FROM documents",
    "path_jail": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS raw FROM pages),
c AS (SELECT *, list_filter(string_split(raw, '/'), lambda x: x <> '.') AS parts FROM p),
f AS (SELECT *, list_filter(list_transform(parts, lambda x: CASE WHEN x = '' THEN 'path.empty' WHEN x = '..' THEN 'path.dotdot' WHEN contains(x, ':') THEN 'path.ads'
  WHEN regexp_matches(x, '[\x00-\x1F\x7F<>"|?*]') THEN 'path.invalid_char' WHEN x LIKE '%.' OR x LIKE '% ' THEN 'path.trailing'
  WHEN list_contains([DEVICES], upper(string_split(x, '.')[1])) THEN 'path.reserved' END), lambda x: x IS NOT NULL)[1] AS first FROM c),
r AS (SELECT *, CASE WHEN octet_length(encode(raw)) <> length(raw) THEN 'path.unicode' WHEN contains(raw, chr(92)) THEN 'path.invalid_char' WHEN regexp_matches(raw, '^(/|[A-Za-z]:)') THEN 'path.absolute'
  WHEN first IS NOT NULL THEN first WHEN len(parts) = 0 THEN 'path.empty' WHEN len(parts) > 32 THEN 'path.depth' END AS code FROM f)
SELECT page_id, code, CASE WHEN code IS NULL THEN array_to_string(parts, '/') END AS path FROM r""".replace("DEVICES", ", ".join(f"'{x}'" for x in RESERVED)),
    "content_root": rf"""WITH d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS own FROM documents),
b AS (SELECT doc_id, '01000000' || {_le("octet_length(encode(path))", 4)} || hex(encode(path)) || '01' || {_le("size", 8)} || own AS body FROM d)
SELECT doc_id::VARCHAR AS archive_id, sha256(unhex(hex(encode('tree.content.v1 ' || (length(body) // 2)::BIGINT)) || '00' || body)) AS root FROM b""",
    "first_failure": _of_kinds("SELECT doc_id::VARCHAR AS archive_id, CASE WHEN phase = 'structure' THEN code END AS code FROM a WHERE phase IS DISTINCT FROM 'source'"),
    "verdict_axes": _of_kinds("""SELECT doc_id::VARCHAR AS archive_id, phase, code, coalesce(code, 'ALLOWED') AS result,
CASE WHEN phase = 'source' THEN 'indeterminate' WHEN code = 'format.unsupported' THEN 'unsupported' WHEN phase = 'structure' THEN 'malformed' ELSE 'interpreted' END AS interpretation,
CASE WHEN phase IS NULL THEN 'admitted' WHEN phase IN ('admission', 'verification') OR code = 'quota.archive' THEN 'denied' ELSE 'not-evaluated' END AS admission,
CASE WHEN phase IS NULL THEN 'complete' WHEN phase = 'verification' THEN 'partial' ELSE 'structure-only' END AS verification, 'not-requested' AS effect,
CASE WHEN phase IS NULL THEN 'complete' ELSE 'partial' END AS completeness, CASE WHEN phase IS NULL THEN 'allowed' ELSE 'rejected' END AS verdict FROM a"""),
    "exit_codes": _of_kinds("SELECT CASE WHEN phase IS NULL THEN 0 ELSE 2 END::INTEGER AS exit_code, count(*) AS n FROM a GROUP BY ALL"),
    "fault_counts": _of_kinds("SELECT 'kind' || kind AS class, coalesce(code, 'ALLOWED') AS result, count(*) AS n, min(doc_id::VARCHAR) AS first FROM a GROUP BY ALL"),
    "expectation_diff": _of_kinds(f"""SELECT * FROM (SELECT 'count' AS kind, coalesce(f.key, e.key) AS key, coalesce(e.n, '0') AS expected, coalesce(f.n, '0') AS actual
  FROM (SELECT 'kind' || kind || '/' || coalesce(code, 'ALLOWED') AS key, count(*)::VARCHAR AS n FROM a GROUP BY ALL) f FULL JOIN (VALUES ('kind0/ALLOWED', '10'), ('kind1/format.unsupported', '5')) e(key, n) ON f.key = e.key
UNION ALL SELECT 'allow', coalesce(f.path, e.path), CASE WHEN e.path IS NULL THEN 'rejected' ELSE 'allowed' END, CASE WHEN f.path IS NULL THEN 'rejected' ELSE 'allowed' END
  FROM (SELECT 'corpus/kind' || kind || '/' || doc_id || '.zip' AS path FROM a WHERE phase IS NULL) f FULL JOIN (SELECT 'corpus/kind0/' || {len(KINDS)} * unnest(range(10)) || '.zip' AS path) e ON f.path = e.path
UNION ALL SELECT 'total', '', '15', count(*)::VARCHAR FROM a) WHERE expected <> actual"""),
    "finding_sequence": """WITH d AS (SELECT doc_id // 10 AS k, doc_id % 10 AS seq FROM documents WHERE doc_id % 10 <> 8),
g AS (SELECT *, CASE seq WHEN 1 THEN 'path.dotdot' WHEN 6 THEN 'path.dotdot' WHEN 3 THEN 'path.ads' WHEN 7 THEN 'path.trailing' WHEN 2 THEN CASE WHEN bool_or(seq = 0) OVER w THEN 'path.case_fold' END
  WHEN 4 THEN CASE WHEN bool_or(seq = 0) OVER w THEN 'zip.diff.b1_dup' END WHEN 5 THEN CASE WHEN bool_or(seq = 0 OR seq = 4) OVER w THEN 'path.conflict' WHEN bool_or(seq = 2) OVER w THEN 'path.case_fold' END
  WHEN 9 THEN CASE WHEN bool_or(seq IN (0, 4, 5)) OVER w THEN 'path.conflict' WHEN bool_or(seq = 2) OVER w THEN 'path.case_fold' END END AS code FROM d WINDOW w AS (PARTITION BY k))
SELECT k::VARCHAR AS archive_id, CASE WHEN count(code) > 0 THEN 'admission' END AS phase, coalesce(string_agg(code, '+' ORDER BY seq), 'ALLOWED') AS result FROM g GROUP BY k""",
    "quota_total": """WITH m AS (SELECT l_orderkey, l_linenumber, max(l_partkey)::BIGINT AS plain FROM lineitem GROUP BY ALL),
t AS (SELECT *, sum(CASE WHEN plain <= 1800 THEN plain END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS total FROM m),
s AS (SELECT *, min(CASE WHEN plain <= 1800 AND total > 3000 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop FROM t)
SELECT l_orderkey::VARCHAR AS archive_id, l_linenumber::INTEGER AS cd_index, CASE WHEN plain > 1800 THEN 'quota.member' ELSE 'quota.total' END AS code FROM s WHERE (stop IS NULL OR l_linenumber <= stop) AND (plain > 1800 OR l_linenumber = stop)""",
    "ancestor_conflicts": """WITH d AS (SELECT lang AS source, doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '/' || doc_id // 5 % 7 AS folder FROM documents),
f AS (SELECT DISTINCT source, folder FROM d WHERE doc_id % 5 = 0), l AS (SELECT DISTINCT source, lower(folder) AS folder FROM f)
SELECT source AS archive_id, doc_id AS cd_index, CASE WHEN f.folder IS NOT NULL THEN 'path.conflict' ELSE 'path.case_fold' END AS code
FROM d LEFT JOIN f USING (source, folder) WHERE doc_id % 5 <> 0 AND (source, lower(d.folder)) IN (SELECT (source, folder) FROM l)""",
    "layout_gaps": """WITH d AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS stop, sum(n_chars) OVER (PARTITION BY source) AS lim FROM documents WHERE n_chars > 8),
r AS (SELECT source, doc_id, stop - n_chars + (doc_id % 97 = 0)::INT AS start, stop + (doc_id % 89 = 0)::INT AS stop, lim FROM d),
o AS (SELECT *, lag(stop) OVER w AS before, lead(start) OVER w IS NULL AS last FROM r WINDOW w AS (PARTITION BY source ORDER BY start, doc_id)),
c AS (SELECT source, CASE WHEN stop > lim THEN 0 WHEN before IS NULL AND start <> 0 THEN 1 WHEN before <> start THEN 1 WHEN last AND stop <> lim THEN 2 END AS phase,
  CASE WHEN stop > lim THEN doc_id WHEN before IS NULL AND start <> 0 THEN -1 WHEN before <> start THEN start ELSE stop END AS place, CASE WHEN stop > lim OR before > start THEN 'zip.overlap' ELSE 'zip.diff.c1_stream' END AS code FROM o)
SELECT source AS archive_id, arg_min(code, (phase, place)) AS code FROM c WHERE phase IS NOT NULL GROUP BY source""",
    "cdh_lfh_agreement": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN 'zip.diff.a3_name' WHEN l_orderkey % 13 = 0 THEN 'zip.diff.a1_method' WHEN l_orderkey % 7 = 0 THEN 'zip.diff.a5_crypt'
WHEN l_orderkey % 5 = 0 THEN 'zip.flags' WHEN l_orderkey % 3 = 0 OR l_orderkey % 17 = 0 THEN 'zip.diff.a2_size' END AS code FROM lineitem""",
    "views": "SELECT doc_id::VARCHAR AS archive_id, 'allowed' AS verdict, source || '/' || lang || '/' || doc_id || '.txt' AS path, 'file' AS kind, octet_length(encode(text))::BIGINT AS comp_bytes, octet_length(encode(text))::BIGINT AS uncomp_bytes, 'store' AS method, sha256(text) AS sha256 FROM documents",
}
