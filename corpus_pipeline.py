"""Documents to a training mix in five stages; each gets what the one before it wrote.

run(spark, sf_dir) gives the last stage's rows. A stage is a function of (spark, docs, sf_dir).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.automaton import decontaminate
from quayside.llm.lines import drop_repeated_lines
from quayside.llm.minhash import Sketching, drop_near_duplicates
from quayside.llm.mixing import weighted_mix
from quayside.llm.quality import fit, score
from quayside.llm.store import keep


def _beside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``stage``, which adds columns of those names: columns that ``docs`` has of them stay as they are."""
    own = {x: f"_own_{x}" for x in names if x in docs.columns}
    return stage(docs.withColumnsRenamed(own)).drop(*names).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars being that of the changed text; documents left without words go."""
    out = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.3 go. The classifier learns from all labels, read from the tables."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(source, labels)
    return _beside(docs, ("score", "predicted"), lambda d: score(d, model).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that ten documents or more have stay in the first of them only; lines of over 50
    words do from the second document on."""
    options = {"min_docs": 10, "min_chars": 20, "keep_first": True, "long_words": 50, "long_min_docs": 2}
    return _measured(_beside(docs, ("n_lines", "n_dropped"), lambda d: drop_repeated_lines(d, **options)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, Sketching(width=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that benchmark items also have are cut out; documents of which they are over half go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    added = ("n_words", "n_hit", "items", "spans", "over_coverage")
    return _measured(_beside(docs, added, lambda d: decontaminate(d, items, window=10, max_coverage=0.5).where("NOT over_coverage")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half as many tokens as there are, by the target weights of domain, language and source."""
    return weighted_mix(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing sources", mixing)]

#: The classifier can't be expressed in SQL; tests/llm/test_pipeline.py holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
