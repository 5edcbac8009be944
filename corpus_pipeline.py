"""A training corpus from documents: five stages, each written and read again by the next.

quality    documents that the quality classifier rejects go
near_dups  one document of each group of near copies (five-word shingles, similarity 0.8) stays
benchmark  documents that hold a benchmark item go
secrets    found secrets are replaced by their kind in brackets
mix        documents that the source mix takes stay, with the words taken
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, quality, secret_scan, simhash, source_mix
from folio.llm._shared import discard, materialize, table

#: A document stays from this probability of good quality.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")), QUALITY)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs, **simhash.NEAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size, sources = source_mix.words(F.col("text")), F.array("source")
    sizes = materialize(docs.select("doc_id", "source", size.alias("size"), sources.alias("sources")), "sizes")
    totals = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    plan = source_mix.mix(sizes, source_mix.targets(totals))
    discard(sizes)
    return plan.apply(docs, size, sources).where("taken > 0")


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dups_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
