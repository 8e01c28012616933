"""The corpus pipeline: stages over the documents table, each on all that its predecessor kept.

All stages but the last return the columns of documents; run() writes each stage's rows to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattroute.llm import bpe, decontaminate, quality, secrets, simhash
from wattroute.llm.common import materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    trees = quality.fit(docs.where(~quality.fold()), table(spark, sf_dir, "labels").where(~quality.fold()))
    return quality.keep_good(docs, trees)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: by SimHash, as op2_simhash links them, and by five-word shingles of similarity 0.8 or more."""
    return simhash.keep_one(docs, by_fingerprint=True)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.train())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each document."""
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [("quality", good_quality), ("near_copies", near_copies), ("benchmark", no_benchmark), ("secrets", no_secrets), ("tokens", tokens)]
ORACLE_SQL = None  # trained models, fingerprints and token ids are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
