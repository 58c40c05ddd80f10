"""Findings: policy, exceptions, order, fingerprints and renderings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import schemas
from strata.policy import Policy, Suppression

TOOL = "strata"
#: Always reported, whatever the policy says.
UNGOVERNED = "analysis-error"


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    """Findings with the given columns, null elsewhere, in the findings schema."""
    kinds = [part.strip().split(" ", 1) for part in schemas.FINDINGS.replace("map<string,string>", "map<string;string>").split(",")]
    return df.select(*[columns.get(n, F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in kinds])


def properties(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def apply_severity(findings: DataFrame, severities: dict[str, str]) -> DataFrame:
    """Findings of rules that aren't off, with the severity the policy gives; rules it doesn't know keep theirs.

    The policy is a map of a few constants in the plan.
    """
    known = F.create_map(*[F.lit(x) for pair in severities.items() for x in pair]) if severities else F.create_map().cast("map<string,string>")
    given = F.coalesce(F.try_element_at(known, F.col("rule_id")), F.lit("keep"))
    name = F.when(given == "warn", "warning").when(given == "error", "error").otherwise(F.col("severity"))
    return findings.where(given != "off").withColumn("severity", name)


def suppression_rows(spark, suppressions: tuple[Suppression, ...]) -> DataFrame:
    return spark.createDataFrame([(s.rule, s.path, s.line, s.reason) for s in suppressions], schemas.SUPPRESSIONS)


def unsuppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings that no exception covers: same rule and path, and its line if it has one."""
    s = suppressions.select(F.col("rule").alias("_r"), F.col("path").alias("_p"), F.col("line").alias("_l"))
    covers = (F.col("rule_id") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("_l").isNull() | (F.col("_l") == F.col("line")))
    return findings.join(s, covers, "left_anti")


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by place and rule, then by the order in which they were emitted."""
    return findings.orderBy("path", "line", "rule_id", F.col("base_path").asc_nulls_first(), "emit_seq")


def fingerprint(rule: Column, path: Column, name: Column, related: Column, scope: Column) -> Column:
    """A stable id of a finding, without its line."""
    parts = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in (rule, path, name, related)])
    return F.sha2(F.when(scope.isNull(), parts).otherwise(F.concat_ws("\x1f", parts, scope)), 256)


def with_fingerprint(findings: DataFrame) -> DataFrame:
    get = lambda k: F.try_element_at("properties", F.lit(k))
    return findings.withColumn(
        "fingerprint", fingerprint(F.col("rule_id"), F.col("path"), get("qualified_name"), F.col("base_path"), get("clone_scope"))
    )


def limited(findings: DataFrame, families: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pair findings by place, and the family rows that they belong to.

    ``families`` are findings too; a ``family_id`` property ties them to pairs.
    """
    if most < 1:
        raise ValueError("at least one finding must be asked for")
    family = F.try_element_at("properties", F.lit("family_id"))
    pairs = ordered(findings).limit(most)
    named = pairs.select(family.alias("_f")).distinct()
    return ordered(pairs.unionByName(families.join(named, family == F.col("_f"), "left_semi")))


def human_lines(findings: DataFrame) -> DataFrame:
    """One line of text per finding, in order."""
    line = F.format_string("%s:%d: %s[%s]: %s", "path", "line", "severity", "rule_id", "message")
    return ordered(findings).select(line.alias("text"))


def has_errors(findings: DataFrame) -> bool:
    return not findings.where("severity = 'error'").isEmpty()


def sarif_results(findings: DataFrame) -> DataFrame:
    """Each finding as the JSON text of a SARIF result, in order."""

    def place(path: str, line: str, *more: Column) -> Column:
        physical = F.struct(F.struct(F.col(path).alias("uri")).alias("artifactLocation"), F.struct(F.col(line).alias("startLine")).alias("region"))
        return F.struct(*more, physical.alias("physicalLocation"))

    numbers = [F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in ("base_mass", "head_mass", "delta", "threshold", "similarity")]
    extra = F.map_concat(F.map_from_entries(F.filter(F.array(*numbers), lambda x: x["value"].isNotNull())), F.coalesce("properties", F.create_map().cast("map<string,string>")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.when(F.col("severity") == "error", "error").otherwise("warning").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place("path", "line")).alias("locations"),
        F.when(F.col("base_path").isNotNull(), F.array(place("base_path", "base_line", F.lit(1).alias("id")))).alias("relatedLocations"),
        extra.alias("properties"),
    )
    return ordered(findings).select(F.to_json(result).alias("result"))


def sarif_document(findings: DataFrame) -> str:
    """A whole SARIF 2.1.0 document; findings are a report, made on the driver."""
    rules = sorted(r["rule_id"] for r in findings.select("rule_id").distinct().collect())
    results = [json.loads(r["result"]) for r in sarif_results(findings).collect()]
    driver = {"name": TOOL, "rules": [{"id": r, "name": r} for r in rules]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2)


def governed(findings: DataFrame, policy: Policy) -> DataFrame:
    """Severity, exceptions and order at once; analysis errors pass untouched by either."""
    own = findings.where(F.col("rule_id") != UNGOVERNED)
    errors = findings.where(F.col("rule_id") == UNGOVERNED)
    own = apply_severity(own, policy.severities())
    if policy.suppressions:
        own = unsuppressed(own, suppression_rows(findings.sparkSession, policy.suppressions))
    return ordered(own.unionByName(errors))
