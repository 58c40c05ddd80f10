"""Families of clones: components of match edges and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators.graph import connected_components


def clone_families(edges: DataFrame, units: DataFrame) -> DataFrame:
    """``(family, pos)``: every unit with its family, named by the least position; loners are families of one."""
    labels = connected_components(edges.select("q", "c")).select(F.col("node").alias("pos"), F.col("component").alias("family"))
    return units.select("pos").join(labels, "pos", "left").select(F.coalesce("family", "pos").alias("family"), "pos")


def family_risk(production: Column, members: Column) -> Column:
    return F.when(production == 0, "low").when(production == members, "high").otherwise("medium")


def family_summary(families: DataFrame, units: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One row per family of two or more: members, mass, what merging would recover, roles, and where it shows.

    The id hashes the sorted members. Masses are summed as they stand; the largest
    member stays, so the rest is recoverable.
    """
    rows = families.join(units.select("pos", "path", "start_line", "qualified_name", "mass", "role"), "pos")
    if blocks is not None:
        ends = blocks.select(F.col("q").alias("pos")).unionAll(blocks.select(F.col("c").alias("pos"))).distinct()
        rows = rows.join(ends.withColumn("blocked", F.lit(True)), "pos", "left")
    else:
        rows = rows.withColumn("blocked", F.lit(None).cast("boolean"))
    nth = F.row_number().over(Window.partitionBy("family").orderBy("path", "qualified_name", "pos"))
    member = F.concat_ws("\x1f", "path", "qualified_name")
    production = F.count(F.when(~F.col("role").isin("test", "accessor"), 1))
    grouped = rows.withColumn("nth", nth).groupBy("family").agg(
        F.count("*").alias("members"),
        F.sum("mass").alias("family_mass"),
        F.max("mass").alias("largest_mass"),
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
        production.alias("production"),
        F.bool_or(F.coalesce("blocked", F.lit(False))).alias("has_block"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(member)), "\x1e"), 256).alias("digest"),
        F.max(F.when(F.col("nth") == 1, F.struct("path", "start_line", "qualified_name"))).alias("first"),
        F.max(F.when(F.col("nth") == 2, F.struct("path", "start_line", "qualified_name"))).alias("second"),
    )
    return grouped.where("members >= 2").select(
        "family",
        F.concat(F.lit("CF-"), F.substring("digest", 1, 16)).alias("family_id"),
        "members",
        "family_mass",
        "largest_mass",
        F.greatest(F.col("family_mass") - F.col("largest_mass"), F.lit(0.0)).alias("recoverable_mass"),
        "roles",
        family_risk(F.col("production"), F.col("members")).alias("risk"),
        "has_block",
        F.col("first.path").alias("path"),
        F.col("first.start_line").alias("line"),
        F.col("second.path").alias("base_path"),
        F.col("second.start_line").alias("base_line"),
    )
