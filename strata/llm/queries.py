"""The pipeline operators' driver queries: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, extendible, length_buckets, line_rules, line_spread, nra, pu_quality, secrets, simhash, url_templates
from strata.llm.oracles import ORACLES
from strata.session import table

__all__ = ["ORACLES", "QUERIES"]

#: The rules that op9 is asked to apply.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Bytes of a shard that op3 fills: small, so that shards of several depths arise at the smallest scales too.
SHARD_BYTES = 1 << 16


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.pu_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack_by_length(table(spark, sf_dir, "documents"))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.extendible_shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id", "n_links"
    )


def op5_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nra.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_first_rules(table(spark, sf_dir, "documents"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_templates.Rule.parse(*r) for r in URL_RULES]
    return url_templates.filter_urls(table(spark, sf_dir, "pages"), rules)


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.line_spread_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_length_buckets": op2_length_buckets,
    "op3_extendible_shards": op3_extendible_shards,
    "op4_simhash": op4_simhash,
    "op5_nra_top_k": op5_nra_top_k,
    "op6_entropy_secrets": op6_entropy_secrets,
    "op7_bpe_transducer": op7_bpe_transducer,
    "op8_line_rules": op8_line_rules,
    "op9_url_templates": op9_url_templates,
    "op10_line_spread": op10_line_spread,
}
