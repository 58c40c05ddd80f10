"""Weighted complexity: summaries per revision and cutoff, erosion, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTOFFS = (5, 10, 15, 20, 30)


def summaries(units: DataFrame, cutoffs: list[int] | tuple[int, ...], revision: list[str]) -> DataFrame:
    """One row per revision and cutoff, from one scan.

    Each unit goes into partial sums for every cutoff (a list of constants) before
    the only shuffle. Strictly more than the cutoff is high complexity.
    """
    high = F.col("cc") > F.col("cutoff")
    spread = units.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    return spread.groupBy(*revision, "cutoff").agg(
        F.sum("mass").alias("total_mass"),
        F.coalesce(F.sum(F.when(high, F.col("mass"))), F.lit(0.0)).alias("high_mass"),
        F.count(F.when(high, 1)).alias("high_count"),
        F.max("cc").alias("max_cc"),
        F.max("mass").alias("max_mass"),
    ).withColumn("erosion_ratio", F.when(F.col("total_mass") > 0, F.col("high_mass") / F.col("total_mass")).otherwise(0.0))


def top_contributors(units: DataFrame, cutoff: int, revision: list[str], most: int = 3) -> DataFrame:
    """The heaviest units above the cutoff in each revision, ranked."""
    order = Window.partitionBy(*revision).orderBy(F.desc("mass"), "path", "start_line", "qualified_name")
    ranked = units.where(F.col("cc") > cutoff).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most).select(*revision, "rank", "path", "qualified_name", "start_line", "cc", "mass")


def mass_growth(base: Column, head: Column) -> Column:
    """Relative growth; from nothing to something is 1."""
    return F.when(base == 0, F.when(head > 0, 1.0).otherwise(0.0)).otherwise((head - base) / base)


def breaches(growth: Column, delta: Column, ratio: Column, growth_limit: float, delta_limit: float, ratio_limit: float) -> Column:
    """The conditions that are exceeded, strictly, in fixed order, joined by commas."""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(growth > growth_limit, "mass-growth"), F.when(delta > delta_limit, "ratio-delta"), F.when(ratio > ratio_limit, "ratio-level")
            )
        ),
        ",",
    )


def adjacent(series: DataFrame, order: str, keys: list[str], value: str, alias: str) -> DataFrame:
    """Each row with its difference from the one before; the first has none."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn(alias, F.col(value) - before)


def floor_quantiles(rows: DataFrame, value: str, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """Order statistics at index ``floor((n - 1) p)`` of the sorted values of each group."""
    window = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(
        *keys, value, F.row_number().over(window.orderBy(value)).alias("rn"), F.count("*").over(window).alias("n")
    )
    picked = [F.max(F.when(F.col("rn") == F.floor((F.col("n") - 1) * p) + 1, F.col(value))).alias(name) for name, p in shares.items()]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


def largest_commits(churn: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The ``most`` rows ``(*keys, commit, churn)`` of greatest churn for each of ``keys``, ties to the lesser commit, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("churn"), "commit"))
    return churn.withColumn("rank", rank).where(F.col("rank") <= most)


def erosion_delta(base: DataFrame, head: DataFrame, keys: list[str], growth_limit: float = 0.08, delta_limit: float = 0.08, ratio_limit: float = 0.5) -> DataFrame:
    """Head summaries against base ones, with the breached conditions."""
    old = base.select(*keys, F.col("erosion_ratio").alias("base_ratio"), F.col("high_mass").alias("base_high_mass"))
    new = head.select(*keys, F.col("erosion_ratio").alias("head_ratio"), F.col("high_mass").alias("head_high_mass"))
    both = new.join(old, keys)
    both = both.withColumn("delta", F.col("head_ratio") - F.col("base_ratio"))
    both = both.withColumn("growth", mass_growth(F.col("base_high_mass"), F.col("head_high_mass")))
    return both.withColumn("breaches", breaches(F.col("growth"), F.col("delta"), F.col("head_ratio"), growth_limit, delta_limit, ratio_limit))


def same_summary(a: Column, b: Column) -> Column:
    """Equal up to a relative 1e-9, as sums of doubles depend on their order."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
