"""Driver queries of the gate's rules: two years of orders stand for two revisions, documents for functions to scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import coverage, findings, rules
from strata.plans.queries import docs, r6
from strata.policy import Policy
from strata.session import table
from strata.sources import snapshot
from strata.sources.units import document_units

BASE, HEAD = 1996, 1997
#: Limits at which the years of the driver's tables break every rule.
POLICY = Policy().with_rule("function_mass", new_function_limit=10.0, delta_limit=5.0).with_rule("structural_erosion", complexity_cutoff=5, top_contributors=3)
SCAN = Policy().with_rule("near_clone", minimum_sloc=1, minimum_tokens=20, detect_blocks=False)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).where(F.col("year").isin(BASE, HEAD))
    return o.withColumn("path", F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate")).where(F.col("year").isin(BASE, HEAD))  # noqa: E741
    return l.withColumn("path", F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")))


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as functions; two customers share an identity, of which the last counts in the baseline."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    grouped = _orders(spark, sf).join(items, "o_orderkey").groupBy("year", F.col("o_custkey").alias("pos"))
    f = grouped.agg(
        F.count("*").cast("int").alias("sloc"), F.sum("items").cast("int").alias("cc"), F.md5(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ",")).alias("normalized_hash")
    )
    pair = F.floor(F.col("pos") / 2)
    return f.withColumn("mass", T.mass(F.col("cc"), F.col("sloc"))).select(
        "*", F.lit("rust").alias("language"), F.concat(F.lit("c"), (pair % 25).cast("string")).alias("path"), F.floor(pair / 25).cast("string").alias("qualified_name"),
        F.col("pos").cast("int").alias("start_line"), (F.col("pos") + 1).cast("int").alias("end_line"),
    )


def _year(rows: DataFrame, year: int) -> DataFrame:
    return rows.where(F.col("year") == year).drop("year")


def _moves(facts: DataFrame, a: str, b: str, gone: str) -> DataFrame:
    """A manifest of the facts' paths in which two have changed places and one is deleted."""
    old = F.when(F.col("path") == a, b).when(F.col("path") == b, a)
    status = F.when(F.col("path") == gone, "deleted").otherwise("changed")
    return facts.select("path").distinct().select("path", status.alias("status"), old.alias("old_path"))


def _property(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name)).alias(name)


def _numbers(*names: str) -> list[Column]:
    return [r6(F.col(n)).alias(n) for n in names]


def rule_function_mass(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf)
    head = _year(f, HEAD)
    found = rules.function_mass(_year(f, BASE), rules.renamed(head, _moves(head, "c2", "c3", "c24")), POLICY)
    return found.select("path", "line", "message", "base_path", "base_line", *_numbers("base_mass", "head_mass", "delta", "threshold"), _property("qualified_name"))


def rule_lint_growth(spark: SparkSession, sf: str) -> DataFrame:
    quarter = F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string"))
    lints = _orders(spark, sf).groupBy("year", "path", F.col("o_orderpriority").alias("kind"), F.col("o_custkey").cast("string").alias("target_fp")).agg(
        F.array_sort(F.collect_set(quarter)).alias("lint_paths"), F.max("o_orderstatus").alias("target_kind"), F.min("o_orderkey").cast("int").alias("line")
    )
    head = _year(lints, HEAD)
    added = head.where("line % 3 <> 0").select("path", "line")
    found = rules.lint_growth(_year(lints, BASE), rules.renamed(head, _moves(head, "c2", "c3", "c24")), added)
    return found.select("path", "line", "severity", "message", _property("pattern_id"), _property("lint_paths"), _property("target_kind"))


def rule_unsafe_growth(spark: SparkSession, sf: str) -> DataFrame:
    unsafe = _lines(spark, sf).select(
        "year", "path", F.concat("l_returnflag", "l_linestatus").alias("pattern_id"), F.col("l_quantity").cast("int").cast("string").alias("fingerprint"),
        (F.col("l_orderkey") % 50 * 8 + F.col("l_linenumber")).cast("int").alias("line"),
    )
    head = _year(unsafe, HEAD)
    added = head.where("line % 3 <> 0").select("path", "line").distinct()
    found = rules.unsafe_growth(_year(unsafe, BASE), rules.renamed(head, _moves(head, "s2", "s3", "s9")), added)
    return found.groupBy("path", "line", "severity", "message", _property("pattern_id")).agg(F.count("*").alias("n_findings"))


def rule_dependency_growth(spark: SparkSession, sf: str) -> DataFrame:
    edges = _lines(spark, sf).groupBy("year", "path", F.col("l_returnflag").alias("table_path"), F.floor(F.col("l_suppkey") / 10).cast("string").alias("dependency_key")).agg(
        F.max("l_linestatus").alias("source_kind"), F.max(F.when(F.col("l_linenumber") == 7, F.col("l_linestatus"))).alias("source"), F.lit("p").alias("package"),
        (F.sum(F.col("l_quantity").cast("int")) % 2 == 0).alias("default_features"), F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("features"),
        F.min("l_orderkey").cast("int").alias("line"),
    )
    head = _year(edges, HEAD)
    found = rules.dependency_growth(_year(edges, BASE), rules.renamed(head, _moves(head, "s2", "s3", "s9")))
    return found.select("path", "line", "severity", "message", *[_property(p) for p in ("dependency", "table", "change", "source_kind", "added_features")])


def rule_structural_erosion(spark: SparkSession, sf: str) -> DataFrame:
    f = _functions(spark, sf)
    head = _year(f, HEAD)
    moves = _moves(head, "c2", "c3", "c24").where("old_path is not null").select("path", "old_path")
    lines = head.where("pos % 3 = 0").select("path", F.col("end_line").alias("line"))
    found = rules.structural_erosion(_year(f, BASE), head, moves, lines, POLICY)
    shown = ["breaches", "erosion_delta", "high_complexity_mass_growth", "erosion_at_cc_5", "erosion_at_cc_10", "contributor_1_qualified_name", "contributor_1_base_mass", "contributor_3_path"]
    return found.select("path", "line", "severity", "message", *_numbers("base_mass", "head_mass", "delta", "threshold"), *[_property(p) for p in shown])


def rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against those before it: pair findings with their family, and family rows, in report order."""
    found = rules.scan(document_units(docs(spark, sf), table(spark, sf, "labels")), SCAN)
    shown = ["clone_scope", "clone_risk", "family_id", "member_count", "recoverable_mass", "left", "right", "same_file"]
    report = findings.governed(found, SCAN)
    return report.select("path", "line", "rule_id", "severity", "message", "base_path", *_numbers("similarity"), *[_property(p) for p in shown])


def _files(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 3 == 0, ".rs").when(F.col("doc_id") % 3 == 1, ".py").otherwise("/Cargo.toml")
    short, long = F.col("n_chars") <= 200, F.col("n_chars") > 3000
    return docs(spark, sf).select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.when(short | long, "failed").otherwise("analyzed").alias("status"),
        F.when(long, "resource budget exceeded").when(short, "too short").otherwise("").alias("detail"),
    )


def rule_analysis_error(spark: SparkSession, sf: str) -> DataFrame:
    return findings.ordered(rules.analysis_errors(_files(spark, sf))).select("path", "line", "rule_id", "severity", "message")


def incomplete_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why the rules did not all run: one row per kind and detail."""
    return coverage.incomplete_reasons(coverage.rule_coverage(_files(spark, sf), Policy().severities())).select("kind", "detail", "first_path", "n")


def path_filter(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.filter_paths(_files(spark, sf), ["src1/", "src2"]).select("path", "status")


def revision_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """All customers of either year with their status; every seventh of the later year was renamed from the next id."""
    o = _orders(spark, sf).groupBy("year", F.col("o_custkey").cast("string").alias("path")).agg(
        F.md5(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ",")).alias("content_hash"), F.lit("file").alias("kind"), F.max(F.length("o_orderstatus")).alias("mode")
    )
    base, head = _year(o, BASE), _year(o, HEAD)
    moved = head.where("cast(path as bigint) % 7 = 0").select("path", (F.col("path").cast("bigint") + 1).cast("string").alias("old_path"))
    renames = moved.join(base.select(F.col("path").alias("old_path")), "old_path", "left_semi").select("path", "old_path")
    return snapshot.manifest(base, head, renames).select("path", "status", "old_path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rule_function_mass, rule_lint_growth, rule_unsafe_growth, rule_dependency_growth, rule_structural_erosion, rule_scan,
        rule_analysis_error, incomplete_reasons, path_filter, revision_manifest,
    )
}
