"""The gate's rules: baseline and head facts in, findings out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators import blocks, changes, coverage, families, findings, metrics, similarity
from strata.policy import Policy
from strata.session import cut

IDENTITY = ["language", "path", "qualified_name"]
#: Order in which rules emit; ties of place and rule keep it.
STAGES = {"analysis-error": 0, "function-mass": 1, "near-clone": 1, "lint-suppression-growth": 2, "unsafe-surface-growth": 3, "dependency-surface-growth": 4, "structural-erosion": 5}


@dataclass
class Revision:
    """Fact tables of one revision."""

    functions: DataFrame
    lints: DataFrame
    unsafe: DataFrame
    dependencies: DataFrame
    coverage: DataFrame


def _stage(rule: str, within: Column) -> Column:
    return (F.lit(STAGES[rule]).cast("bigint") * (1 << 58) + within).cast("bigint")


def _last(functions: DataFrame) -> DataFrame:
    """One function per identity: the last of those that share it."""
    nth = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.desc("pos")))
    return functions.withColumn("_n", nth).where("_n = 1").drop("_n")


def renamed(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Head facts of changed paths, with ``old_path``: where the baseline has them."""
    moves = manifest.where("status <> 'deleted'").select("path", F.coalesce("old_path", "path").alias("old_path"))
    return facts.join(moves, "path")


def function_mass(base: DataFrame, head: DataFrame, policy: Policy) -> DataFrame:
    """New functions over the limit, and known ones that grew by more than the delta limit.

    ``head`` holds functions of changed files, with ``old_path``. Only functions
    whose token stream changed are looked at.
    """
    limits = policy.function_mass
    known = _last(base).select(
        "language", F.col("path").alias("old_path"), "qualified_name", F.col("mass").alias("b_mass"), F.col("start_line").alias("b_line"), F.col("normalized_hash").alias("b_hash")
    )
    rows = head.join(known, ["language", "old_path", "qualified_name"], "left").where(~F.col("normalized_hash").eqNullSafe(F.col("b_hash")))
    new = rows.where(F.col("b_mass").isNull() & (F.col("mass") > limits.new_function_limit))
    grown = rows.withColumn("delta", F.col("mass") - F.col("b_mass")).where(F.col("delta") > limits.delta_limit)
    named = findings.properties(qualified_name=F.col("qualified_name"))
    common = {"rule_id": F.lit("function-mass"), "severity": F.lit("error"), "path": F.col("path"), "line": F.col("start_line"), "head_mass": F.col("mass"), "properties": named, "emit_seq": _stage("function-mass", F.col("pos"))}
    return findings.shaped(
        new, **common, message=F.format_string(f"new function mass %.2f exceeds limit {limits.new_function_limit:.2f}", "mass"), threshold=F.lit(limits.new_function_limit)
    ).unionByName(
        findings.shaped(
            grown, **common, message=F.format_string(f"function mass increased by %.2f; limit is {limits.delta_limit:.2f}", "delta"),
            base_path=F.col("old_path"), base_line=F.col("b_line"), base_mass=F.col("b_mass"), delta=F.col("delta"), threshold=F.lit(limits.delta_limit),
        )
    )


def whole_findings(matches: DataFrame, policy: Policy) -> DataFrame:
    risk = similarity.risk(F.col("q_role"), F.col("c_role"))
    limit = policy.near_clone.similarity_threshold
    text = F.format_string(f"whole-function structural similarity %.2f%% to %s exceeds threshold {limit * 100:.2f}%% [%s]", F.col("similarity") * 100, "c_qualified_name", risk)
    return findings.shaped(
        matches, emit_seq=_stage("near-clone", F.col("q")), rule_id=F.lit("near-clone"), severity=F.lit("error"), message=text, path=F.col("q_path"), line=F.col("q_start_line"),
        base_path=F.col("c_path"), base_line=F.col("c_start_line"), threshold=F.lit(limit), similarity=F.col("similarity"),
        properties=findings.properties(
            token_similarity=F.format_string("%.6f", "token_similarity"), ast_similarity=F.format_string("%.6f", "ast_similarity"), clone_scope=F.lit("whole-function"),
            clone_risk=risk, left_role=F.col("q_role"), right_role=F.col("c_role"), same_file=F.col("q_path") == F.col("c_path"), left=F.col("q"), right=F.col("c"),
        ),
    )


def block_findings(found: DataFrame, functions: DataFrame, policy: Policy) -> DataFrame:
    q = functions.select(F.col("pos").alias("q"), F.col("path").alias("q_path"), F.col("role").alias("q_role"), F.col("shingle_lines").alias("q_lines"), F.col("start_line").alias("q_start"))
    c = functions.select(F.col("pos").alias("c"), F.col("path").alias("c_path"), F.col("role").alias("c_role"), F.col("shingle_lines").alias("c_lines"), F.col("start_line").alias("c_start"))
    line = lambda lines, at, start: F.coalesce(F.get(lines, at.cast("int")), F.col(start))
    rows = found.join(q, "q").join(c, "c")
    rows = rows.withColumn("left_line", line("q_lines", F.col("left_start"), "q_start")).withColumn("right_line", line("c_lines", F.col("right_start"), "c_start"))
    rows = rows.withColumn("left_end", line("q_lines", F.col("left_start") + F.col("left_length") - 1, "q_start"))
    rows = rows.withColumn("n_lines", F.col("left_end") - F.col("left_line") + 1)
    risk = similarity.risk(F.col("q_role"), F.col("c_role"))
    whole = F.lit("1.000000")
    return findings.shaped(
        rows, emit_seq=_stage("near-clone", F.col("q")) + 1, rule_id=F.lit("near-clone"), severity=F.lit("error"),
        message=F.format_string("block of ~%d statements duplicated at %s:%d [%s]", "n_lines", "c_path", "right_line", risk), path=F.col("q_path"), line=F.col("left_line"),
        base_path=F.col("c_path"), base_line=F.col("right_line"), threshold=F.lit(policy.near_clone.similarity_threshold), similarity=F.lit(1.0),
        properties=findings.properties(
            clone_scope=F.lit("block"), clone_risk=risk, token_containment=whole, ast_containment=whole, island_shingles=F.col("island"), island_lines=F.col("n_lines"),
            left_role=F.col("q_role"), right_role=F.col("c_role"), same_file=F.col("q_path") == F.col("c_path"), left_start_line=F.col("left_line"), right_start_line=F.col("right_line"),
            left=F.col("q"), right=F.col("c"),
        ),
    )


def clone_matches(functions: DataFrame, policy: Policy, **options) -> tuple[DataFrame, DataFrame]:
    """Best whole matches, and block matches with another partner than the whole one."""
    whole = cut(similarity.best_whole_matches(functions, policy.near_clone, **options))
    if not policy.near_clone.detect_blocks:
        return whole, None
    found = blocks.block_matches(functions, policy.near_clone, **options)
    return whole, cut(found.join(whole.select("q", "c"), ["q", "c"], "left_anti"))


def near_clone_check(base: DataFrame, head: DataFrame, head_paths: DataFrame, policy: Policy) -> DataFrame:
    """Clones among functions that changed, against what is left of the baseline and earlier changes.

    Baseline functions of unchanged files that still exist and head versions of
    known ones are always seen; new head functions are seen only by later ones.
    """
    known = _last(base).select("language", F.col("path").alias("old_path"), "qualified_name", F.col("normalized_hash").alias("b_hash"))
    changed = head.join(known, ["language", "old_path", "qualified_name"], "left")
    fresh = ~F.col("normalized_hash").eqNullSafe(F.col("b_hash"))
    now = changed.withColumn("asks", fresh).withColumn("survivor", F.col("b_hash").isNotNull()).drop("b_hash", "old_path")
    gone = head_paths.where("status = 'unchanged'").select("path")
    old = base.join(gone, "path", "left_semi").withColumn("asks", F.lit(False)).withColumn("survivor", F.lit(True))
    columns = [c for c in now.columns if c in old.columns]
    pool = old.select(*columns).withColumn("pos", F.col("pos")).unionByName(now.select(*columns).withColumn("pos", F.col("pos") + (1 << 50)))
    nth = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("pos"))
    pool = cut(pool.withColumn("_n", nth).where("_n = 1").drop("_n"))
    seen = (F.col("survivor") | (F.col("c") < F.col("q")))
    whole, found = clone_matches(pool, policy, visible=seen, query=F.col("asks"))
    out = whole_findings(whole, policy)
    return out if found is None else out.unionByName(block_findings(found, pool, policy))


def _firsts(functions: DataFrame) -> DataFrame:
    """One function per identity: the first of those that share it; only these are moved."""
    again = cut(functions.groupBy(*IDENTITY).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in IDENTITY]))
    if again.isEmpty():
        return functions
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY])
    nth = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("pos"))
    few = cut(functions.join(again, same, "left_semi").withColumn("_n", nth).where("_n = 1").drop("_n"))
    return functions.join(again, same, "left_anti").unionByName(few)


def scan(functions: DataFrame, policy: Policy) -> DataFrame:
    """Every function against those before it: pair findings and one row per family.

    ``functions`` may be a plan that computes its streams; they are stored only where blocks need them.
    """
    pool = _firsts(functions)
    pool = cut(pool) if policy.near_clone.detect_blocks else pool
    whole, found = clone_matches(pool, policy)
    edges = whole.select("q", "c") if found is None else whole.select("q", "c").unionByName(found.select("q", "c"))
    groups = cut(families.clone_families(edges, pool))
    summary = families.family_summary(groups, pool, found)
    pairs = whole_findings(whole, policy)
    if found is not None:
        pairs = pairs.unionByName(block_findings(found, pool, policy))
    ids = groups.join(summary.select("family", "family_id"), "family").select(F.col("pos").alias("_pos"), "family_id")
    left = F.try_element_at("properties", F.lit("left")).cast("bigint")
    pairs = pairs.join(ids, left == F.col("_pos"), "left").withColumn("properties", F.map_concat("properties", F.create_map(F.lit("family_id"), "family_id"))).drop("_pos", "family_id")
    rows = findings.shaped(
        summary, emit_seq=_stage("near-clone", F.col("family")) + 2, rule_id=F.lit("near-clone"), severity=F.lit("error"),
        message=F.format_string("clone family %s has %d members; recoverable mass %.2f [%s]", "family_id", "members", "recoverable_mass", "risk"),
        path=F.col("path"), line=F.col("line"), base_path=F.col("base_path"), base_line=F.col("base_line"),
        properties=findings.properties(
            family_id=F.col("family_id"), clone_scope=F.lit("family"), member_count=F.col("members"), roles=F.col("roles"), clone_risk=F.col("risk"), has_block_match=F.col("has_block"),
            family_mass=F.format_string("%.6f", "family_mass"), recoverable_mass=F.format_string("%.6f", "recoverable_mass"),
        ),
    )
    return pairs.unionByName(rows)


def lint_growth(base: DataFrame, head: DataFrame, lines: DataFrame) -> DataFrame:
    """Suppressions on added lines that the baseline doesn't have, told apart from broadened ones."""
    added = head.join(lines.select("path", "line"), ["path", "line"], "left_semi")
    old = base.select(F.col("path").alias("old_path"), "kind", "target_fp", "lint_paths")
    rows = changes.broadened(added, old, ["old_path", "kind", "target_fp"], "lint_paths")
    return findings.shaped(
        rows, emit_seq=_stage("lint-suppression-growth", F.col("line")), rule_id=F.lit("lint-suppression-growth"), severity=F.lit("warning"), path=F.col("path"), line=F.col("line"),
        message=F.when(F.col("broadened"), "lint suppression broadened").otherwise("new lint suppression introduced"),
        properties=findings.properties(pattern_id=F.col("kind"), lint_paths=F.array_join("lint_paths", ","), target_kind=F.col("target_kind")),
    )


def unsafe_growth(base: DataFrame, head: DataFrame, lines: DataFrame) -> DataFrame:
    """Unsafe constructs on added lines that cancel with none of the baseline's, by content, then by line."""
    added = head.join(lines.select("path", "line"), ["path", "line"], "left_semi")
    columns = ["old_path", "pattern_id", "fingerprint", "line"]
    old = base.select(F.col("path").alias("old_path"), *columns[1:])
    rows = changes.bag_difference(added.select("path", *columns), old, columns[:3], ["old_path", "pattern_id", "line"], ["line"])
    return findings.shaped(
        rows, emit_seq=_stage("unsafe-surface-growth", F.col("line")), rule_id=F.lit("unsafe-surface-growth"), severity=F.lit("warning"), path=F.col("path"), line=F.col("line"),
        message=F.concat(F.lit("new "), "pattern_id", F.lit(" introduced")), properties=findings.properties(pattern_id=F.col("pattern_id")),
    )


def dependency_growth(base: DataFrame, head: DataFrame) -> DataFrame:
    """New edges, edges from another source, and edges with more features or defaults switched on."""
    keys = ["old_path", "table_path", "dependency_key"]
    old = base.select(
        F.col("path").alias("old_path"), "table_path", "dependency_key", F.col("source_kind").alias("b_kind"), F.col("source").alias("b_source"),
        F.col("package").alias("b_package"), F.col("features").alias("b_features"), F.col("default_features").alias("b_default"), F.lit(True).alias("known"),
    )
    rows = head.join(old, keys, "left")
    rows = rows.withColumn("more", F.array_except("features", F.coalesce("b_features", F.array().cast("array<string>"))))
    moved = ~F.col("source_kind").eqNullSafe(F.col("b_kind")) | ~F.col("source").eqNullSafe(F.col("b_source")) | ~F.col("package").eqNullSafe(F.col("b_package"))
    wider = (F.size("more") > 0) | (F.col("default_features") & ~F.col("b_default"))
    change = F.when(F.col("known").isNull(), "new").when(moved, "source changed").when(wider, "features expanded")
    rows = rows.withColumn("change", change).where("change is not null")
    return findings.shaped(
        rows, emit_seq=_stage("dependency-surface-growth", F.col("line")), rule_id=F.lit("dependency-surface-growth"), severity=F.lit("warning"), path=F.col("path"), line=F.col("line"),
        message=F.format_string("dependency %s in %s: %s", "dependency_key", "table_path", "change"),
        properties=findings.properties(dependency=F.col("dependency_key"), table=F.col("table_path"), change=F.col("change"), source_kind=F.col("source_kind"), added_features=F.array_join(F.array_sort("more"), ",")),
    )


def structural_erosion(base: DataFrame, head: DataFrame, moves: DataFrame, lines: DataFrame, policy: Policy) -> DataFrame:
    """At most one finding: the head's high-complexity share or mass against the baseline's.

    ``moves`` maps head paths to the baseline's where they differ. The place is the
    changed function that grew most, else the head's heaviest one.
    """
    limits = policy.structural_erosion
    cutoff = limits.complexity_cutoff
    cutoffs = sorted({cutoff, *metrics.CUTOFFS})
    empty = [F.lit(0.0).alias("total_mass"), F.lit(0.0).alias("high_mass"), F.lit(0.0).alias("erosion_ratio")]
    one = head.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff"))

    def summary(functions: DataFrame) -> DataFrame:
        s = metrics.summaries(functions, cutoffs, []).select("cutoff", "total_mass", "high_mass", "erosion_ratio")
        return s.unionByName(one.select("cutoff", *empty)).groupBy("cutoff").agg(*[F.max(c).alias(c) for c in ("total_mass", "high_mass", "erosion_ratio")])

    told = metrics.erosion_delta(summary(base), summary(head), ["cutoff"], limits.mass_growth_limit, limits.delta_limit, limits.erosion_limit)
    by_cutoff = told.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("erosion_at_cc_"), F.col("cutoff").cast("string")), F.format_string("%.6f", "head_ratio")))).alias("ratios"))
    main = told.where((F.col("cutoff") == cutoff) & (F.col("breaches") != ""))
    old = _last(base).select("language", F.col("path").alias("old_path"), "qualified_name", F.col("mass").alias("b_mass"))
    here = head.join(moves, "path", "left").withColumn("old_path", F.coalesce("old_path", "path"))
    touched = here.alias("f").join(lines.alias("l"), (F.col("f.path") == F.col("l.path")) & F.col("l.line").between(F.col("f.start_line"), F.col("f.end_line")), "left_semi")
    grown = touched.join(old, ["language", "old_path", "qualified_name"], "left").where((F.col("cc") > cutoff) & (F.col("b_mass").isNull() | (F.col("mass") > F.col("b_mass"))))
    by = [F.desc(F.col("mass") - F.coalesce("b_mass", F.lit(0.0))), F.desc("mass"), "path", "start_line", "qualified_name"]
    most = grown.orderBy(*by).limit(limits.top_contributors).withColumn("n", F.row_number().over(Window.orderBy(*by)))
    entries = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("n", "path", "qualified_name", "start_line", "cc", "mass", "b_mass"))),
            lambda x: F.transform(
                F.array(
                    F.struct(F.lit("path").alias("k"), x["path"].alias("v")),
                    F.struct(F.lit("qualified_name").alias("k"), x["qualified_name"].alias("v")),
                    F.struct(F.lit("line").alias("k"), x["start_line"].cast("string").alias("v")),
                    F.struct(F.lit("cc").alias("k"), x["cc"].cast("string").alias("v")),
                    F.struct(F.lit("head_mass").alias("k"), F.format_string("%.6f", x["mass"]).alias("v")),
                    F.struct(F.lit("base_mass").alias("k"), F.coalesce(F.format_string("%.6f", x["b_mass"]), F.lit("new")).alias("v")),
                ),
                lambda y: F.struct(F.concat(F.lit("contributor_"), x["n"].cast("string"), F.lit("_"), y["k"]).alias("key"), y["v"].alias("value")),
            ),
        )
    )
    contributors = most.agg(F.map_from_entries(entries).alias("contributors"), F.min(F.when(F.col("n") == 1, F.struct("path", "start_line"))).alias("place"))
    heavy = F.when(F.col("cc") > cutoff, F.struct((-F.col("mass")).alias("m"), "path", "start_line"))
    fallback = head.agg(F.min(heavy).alias("heaviest"))
    row = main.crossJoin(by_cutoff).crossJoin(contributors).crossJoin(fallback)  # one row each
    message = F.format_string(
        f"structural erosion at %.2f%% (base %.2f%%, ratio delta %+.2f%%, high-complexity mass %+.2f%% at CC>{cutoff}) [%s]",
        F.col("head_ratio") * 100, F.col("base_ratio") * 100, F.col("delta") * 100, F.col("growth") * 100, "breaches",
    )
    six = lambda c: F.format_string("%.6f", c)
    fixed = findings.properties(
        base_erosion_ratio=six("base_ratio"), head_erosion_ratio=six("head_ratio"), erosion_delta=six("delta"), base_high_complexity_mass=six("base_high_mass"),
        head_high_complexity_mass=six("head_high_mass"), high_complexity_mass_growth=six("growth"), breaches=F.col("breaches"), complexity_cutoff=F.lit(cutoff),
        mass_growth_limit=F.lit(f"{limits.mass_growth_limit:.6f}"), erosion_limit=F.lit(f"{limits.erosion_limit:.6f}"), delta_limit=F.lit(f"{limits.delta_limit:.6f}"),
    )
    return findings.shaped(
        row, emit_seq=_stage("structural-erosion", F.lit(0)), rule_id=F.lit("structural-erosion"), severity=F.lit("error"), message=message,
        path=F.coalesce("place.path", "heaviest.path", F.lit("<repository>")), line=F.coalesce("place.start_line", "heaviest.start_line", F.lit(1)),
        base_mass=F.col("base_high_mass"), head_mass=F.col("head_high_mass"), delta=F.col("delta"), threshold=F.lit(limits.delta_limit),
        properties=F.map_concat(fixed, "ratios", "contributors"),
    )


def analysis_errors(coverage: DataFrame) -> DataFrame:
    return findings.shaped(
        coverage.where("status = 'failed'"), emit_seq=_stage("analysis-error", F.lit(0)), rule_id=F.lit("analysis-error"), severity=F.lit("warning"),
        message=F.concat(F.lit("could not analyze file: "), "detail"), path=F.col("path"), line=F.lit(1),
    )


def erosion_can_run(head: Revision, failed_diffs: DataFrame | None = None) -> bool:
    """Whether every Rust file was analysed and has its added lines."""
    return coverage.complete_for(head.coverage) and (failed_diffs is None or failed_diffs.where(F.col("path").rlike(coverage.RUST)).isEmpty())


def evaluate(base: Revision, head: Revision, manifest: DataFrame, lines: DataFrame, policy: Policy, erosion: bool | None = None) -> DataFrame:
    """All rules over two revisions, governed and ordered.

    ``manifest`` has ``(path, status, old_path)`` of every head path and of deleted
    ones, status being added, changed, unchanged or deleted; ``lines`` the added
    lines of head paths. Erosion is left out unless every Rust file was analysed;
    ``erosion`` says so where a caller knows more.
    """
    moved = manifest.where("status in ('added', 'changed')")
    changed = {k: renamed(getattr(head, k), moved) for k in ("functions", "lints", "unsafe", "dependencies")}
    out = function_mass(base.functions, changed["functions"], policy)
    out = out.unionByName(near_clone_check(base.functions, changed["functions"], manifest, policy))
    out = out.unionByName(lint_growth(base.lints, changed["lints"], lines)).unionByName(unsafe_growth(base.unsafe, changed["unsafe"], lines))
    out = out.unionByName(dependency_growth(base.dependencies, changed["dependencies"]))
    out = out.unionByName(analysis_errors(head.coverage.join(moved.select("path"), "path", "left_semi")))
    if erosion_can_run(head) if erosion is None else erosion:
        rust = lambda r: r.functions.where("language = 'rust'")
        moves = manifest.where("old_path is not null").select("path", "old_path")
        out = out.unionByName(structural_erosion(rust(base), rust(head), moves, lines, policy))
    return findings.governed(cut(out), policy)
