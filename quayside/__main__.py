"""python -m quayside ARCHIVE [--dest FOLDER], or python -m quayside --classify FOLDER [--expect FILE].

The first prints an archive's view to stdout and its receipt to stderr; with a destination, the archive is published there.
The second prints how many archives of each class come to each result, and compares that with a written expectation.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quayside.operators import gate, outcomes
from quayside.operators.documents import documents
from quayside.operators.policy import Policy
from quayside.sinks.folder import publish
from quayside.sources.archives import requested, scan


def one(spark: SparkSession, archive: str, dest: str | None) -> int:
    policy, uri = Policy(), "file:" + os.path.abspath(archive)
    wanted = spark.createDataFrame([(uri,)], "archive_id string")
    files = scan(spark, archive, policy.max_archive_bytes) if os.path.exists(archive) else wanted.selectExpr("'' AS archive_id", "0L AS length", "CAST(NULL AS binary) AS content").limit(0)
    archives = requested(files, wanted)
    found = outcomes.inspected(archives, policy.caps(), max_bytes=policy.max_archive_bytes).persist()
    answer = outcomes.judged(found)
    made = documents(found, policy, path=F.lit(archive)).first()
    view, receipt = json.loads(made.view), json.loads(made.receipt)
    if dest is not None:
        parent, name = os.path.split(os.path.abspath(dest))
        report = spark.createDataFrame([r.asDict() for r in publish(archives, parent, policy.caps(), name="'" + name.replace("'", "''") + "'").collect()], "archive_id string, outcome string, cleanup string, code string")
        answer = outcomes.with_effect(answer, report)
        receipt["materialization"] = report.select("outcome", "cleanup", "code").first().asDict()
    last = answer.first().asDict()
    for document in (view, receipt):
        document |= {"verdict": last["verdict"], "wrote": bool(last.get("wrote"))}
        document["effect"] = {"status": last["effect"]}
    print(json.dumps(view, indent=2))
    print(json.dumps(receipt, indent=2), file=sys.stderr)
    return last["exit_code"]


def classify(spark: SparkSession, folder: str, expect: str | None) -> int:
    base = "file:" + os.path.abspath(folder) + "/"
    archives = scan(spark, folder)
    found = outcomes.inspect(archives).withColumn("path", F.expr(f"substring(archive_id, {len(base) + 1})"))
    found = found.withColumn("class", F.when(F.contains("path", F.lit("/")), gate.class_of(F.col("path"))).otherwise(os.path.basename(os.path.abspath(folder)))).persist()
    print("class\tresult\tcount\tfirst")
    for r in outcomes.corpus_counts(found, F.col("class")).orderBy("class", "result").toLocalIterator():
        print(r["class"], r.result, r.n, r["first"], sep="\t")
    sizes = archives.select(F.expr(f"substring(archive_id, {len(base) + 1})").alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    digest = gate.corpus_digest(sizes)
    print("corpus", "sha256", digest, sep="\t")
    if expect is None:
        return 0
    with open(expect, encoding="utf-8") as text:
        differ = gate.differences(found, gate.read_expectations(text.read()), digest).orderBy("kind", "key").collect()
    for r in differ:
        print(f"differs: {r.kind} {r.key}: expected {r.expected}, got {r.actual}", file=sys.stderr)
    return 1 if differ else 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quayside")
    parser.add_argument("archive", nargs="?")
    parser.add_argument("--dest")
    parser.add_argument("--classify")
    parser.add_argument("--expect")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if given.classify:
        return classify(spark, given.classify, given.expect)
    return one(spark, given.archive, given.dest)


if __name__ == "__main__":
    sys.exit(main())
