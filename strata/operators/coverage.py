"""What was analysed, which rules could run, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.session import cut

SOURCE = r"\.(rs|py|ts|tsx)$"
RUST = r"\.rs$"
MANIFEST = r"(^|/)Cargo\.toml$"


def rule_applies(rule: Column, path: Column) -> Column:
    return (
        F.when(rule.isin("function-mass", "near-clone"), path.rlike(SOURCE))
        .when(rule.isin("lint-suppression-growth", "unsafe-surface-growth", "structural-erosion"), path.rlike(RUST))
        .when(rule == "dependency-surface-growth", path.rlike(MANIFEST))
        .otherwise(False)
    )


def rule_coverage(
    files: DataFrame, severities: dict[str, str], diff_errors: DataFrame | None = None, changed: DataFrame | None = None, erosion_ran: bool = True
) -> DataFrame:
    """One row per path and rule: whether the rule applies, whether it ran, and why not.

    ``files`` has ``(path, status, detail)``; the rules are a few constants. A rule
    that doesn't apply counts as completed. A failed line diff fails the rules that
    look at added lines. With ``changed`` paths, all rules but erosion apply to these
    alone. Where erosion did not run, its rows keep their file's status, as another
    file is the reason.
    """
    rules = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity")) for r, s in severities.items()])
    rows = files.select("path", F.col("status").alias("file_status"), F.col("detail").alias("file_detail"), F.explode(rules).alias("r"))
    rows = rows.select("path", "file_status", "file_detail", "r.rule_id", "r.severity")
    if diff_errors is None:
        rows = rows.withColumn("diff_error", F.lit(None).cast("string"))
    else:
        rows = rows.join(diff_errors.select("path", F.col("detail").alias("diff_error")), "path", "left")
    needs_lines = F.col("rule_id").isin("lint-suppression-growth", "unsafe-surface-growth")
    erosion = F.col("rule_id") == "structural-erosion"
    applies = rule_applies(F.col("rule_id"), F.col("path"))
    if changed is not None:
        rows = rows.join(changed.select("path", F.lit(True).alias("changed")), "path", "left")
        applies = applies & (erosion | F.col("changed").isNotNull())
    off = F.col("severity") == "off"
    diff_failed = needs_lines & F.col("diff_error").isNotNull()
    completed = off | ~applies | ((F.col("file_status") == "analyzed") & ~diff_failed & (F.lit(erosion_ran) | ~erosion))
    status = (
        F.when(off, "disabled").when(~applies, "not-applicable").when(completed, "completed").when(diff_failed, "failed").otherwise(F.col("file_status"))
    )
    detail = (
        F.when(off, "rule is off")
        .when(~applies, "rule does not apply to this path")
        .when(completed, "")
        .when(diff_failed, F.col("diff_error"))
        .otherwise(F.coalesce("file_detail", F.lit("")))
    )
    return rows.select("path", "rule_id", applies.alias("applicable"), completed.alias("completed"), status.alias("status"), detail.alias("detail"))


def within_budget(entries: DataFrame, key: str, size: Column, most_bytes: int, most_files: int, groups: list[str] | None = None) -> DataFrame:
    """Entries in order with running totals; the first over a budget fails all after it.

    Ranges of the order are summed on their own, and only their totals, a row for
    each range and group, are summed over all.
    """
    groups = groups or []
    rows = _ranges(entries.withColumn("_size", size), *groups, key)
    window = Window.partitionBy("_part", *groups).orderBy(key)
    inside = rows.withColumn("running_bytes", F.sum("_size").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = inside.withColumn("file_index", F.row_number().over(window))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *groups).agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_files"))
    totals = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(["_part", *groups])], F.sum("_bytes").over(before).alias("_bytes"), F.sum("_files").over(before).alias("_files"))
    same = F.lit(True)
    for i, c in enumerate(["_part", *groups]):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    rows = inside.join(totals, same).withColumn("running_bytes", F.col("running_bytes") + F.coalesce("_bytes", F.lit(0)))
    rows = rows.withColumn("file_index", (F.col("file_index") + F.coalesce("_files", F.lit(0))).cast("int")).select(*entries.columns, "running_bytes", "file_index")
    ok = (F.col("running_bytes") <= most_bytes) & (F.col("file_index") <= most_files)
    return rows.withColumn("status", F.when(ok, "analyzed").otherwise("failed")).withColumn(
        "detail", F.when(ok, "").otherwise("resource budget exceeded")
    )


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of the order, stored with their range's number ``_part``; equal rows share one."""
    return cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def incomplete_reasons(coverage: DataFrame) -> DataFrame:
    """Distinct reasons why a run is incomplete, in the order first seen."""
    kind = (
        F.when(F.col("detail").contains("budget"), "budget-exceeded")
        .when(F.col("detail").contains("cancelled"), "cancelled")
        .when(F.col("status") == "unsupported", "unsupported")
        .otherwise("analysis-failed")
    )
    bad = coverage.where(~F.col("status").isin("analyzed", "completed", "disabled", "not-applicable"))
    return bad.groupBy(kind.alias("kind"), "detail").agg(F.min("path").alias("first_path"), F.count("*").alias("n")).orderBy("first_path", "kind")


def complete_for(coverage: DataFrame, pattern: str = RUST) -> bool:
    """Whether every matching path was analysed."""
    return coverage.where(F.col("path").rlike(pattern) & (F.col("status") != "analyzed")).isEmpty()


def unsorted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key isn't strictly greater than that of the row before; ``order`` has no ties.

    Each range of the order looks at itself; its first row looks at the last of the range before.
    """
    parts = _ranges(rows, order)
    lasts = parts.groupBy("_part").agg(F.max_by(key, order).alias("_last"))
    lasts = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))
    inside = parts.withColumn("_before", F.lag(key).over(Window.partitionBy("_part").orderBy(order)))
    told = inside.join(lasts, "_part").withColumn("_before", F.coalesce("_before", "_last"))
    return told.where(F.col("_before") >= F.col(key)).select(*rows.columns)


def filter_paths(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Rows at one of the paths or below a directory among them; an unknown path is an error."""
    if not paths:
        return rows
    clean = [p.rstrip("/") for p in paths]
    inside = [(F.col("path") == p) | F.startswith(F.col("path"), F.lit(p + "/")) for p in clean]
    seen = rows.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"p{i}") for i, c in enumerate(inside)]).first()
    for i, p in enumerate(clean):
        if not seen[f"p{i}"]:
            raise ValueError(f"no analysed file at {p}")
    keep = inside[0]
    for c in inside[1:]:
        keep = keep | c
    return rows.where(keep)
