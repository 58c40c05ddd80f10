"""Complexity over a repository's history: each distinct content is analysed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.extract.tables import extract_entries, functions_table
from strata.operators import metrics
from strata.session import cut


def revision_summaries(entries: DataFrame, cutoffs: list[int], pattern: str = r"\.rs$") -> DataFrame:
    """Summaries per revision and cutoff over many revisions' entries.

    Contents that several revisions share are extracted once: entries are first
    reduced to distinct (path, content), and facts joined back by content hash.
    """
    own = entries.where(F.col("path").rlike(pattern)).withColumn("content", F.sha2("bytes", 256))
    links = own.select(F.col("rev_id").alias("revision"), "path", "content")
    distinct = own.groupBy("path", "content").agg(F.first("bytes").alias("bytes"), F.first("kind").alias("kind"))
    facts = functions_table(cut(extract_entries(distinct.select(F.col("content").alias("rev_id"), "path", "kind", "bytes"))))
    units = links.join(facts.withColumnRenamed("rev_id", "content").drop("kind"), ["path", "content"])
    return metrics.summaries(units, cutoffs, ["revision"])


def parse_cutoffs(text: str) -> list[int]:
    """Cutoffs from a comma list; the first is the headline."""
    values = [int(x) for x in text.split(",")]
    if not values or len(set(values)) != len(values) or min(values) < 0:
        raise ValueError("cutoffs must be distinct and not negative")
    return values
