"""A training corpus from ``documents``, stage by stage.

Each stage reads what its predecessor wrote, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import length_buckets, line_spread, near_copies, pu_quality, secrets
from strata.session import scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share leave the texts that have others."""
    return line_spread.remove_spread_lines(docs, max_loss=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secrets.redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its length bucket and its batch."""
    return length_buckets.pack_by_length(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: A trained classifier and a fingerprint over XXH64 have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{at}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
