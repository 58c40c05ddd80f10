"""Command line: init, index, check, scan and history. Exit codes: 0 clean, 1 errors found, 2 failed."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from strata import policy as policies
from strata.operators import findings, rules
from strata.operators.coverage import filter_paths
from strata.plans.history import parse_cutoffs, revision_summaries
from strata.sources import snapshot
from strata.sources.git import GitError, Repository

POLICY_FILE = "strata.toml"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strata")
    parser.add_argument("--policy", default=POLICY_FILE)
    verbs = parser.add_subparsers(dest="verb", required=True)
    init = verbs.add_parser("init")
    init.add_argument("--force", action="store_true")
    index = verbs.add_parser("index")
    index.add_argument("--ref", default="HEAD")
    index.add_argument("--output", required=True)
    check = verbs.add_parser("check")
    check.add_argument("--base", required=True)
    check.add_argument("--head", default="HEAD")
    check.add_argument("--index", required=True)
    scan = verbs.add_parser("scan")
    scan.add_argument("--ref", default="HEAD")
    scan.add_argument("--working-tree", action="store_true")
    scan.add_argument("--no-ignore", action="store_true")
    scan.add_argument("--path", action="append", default=[])
    scan.add_argument("--threshold", type=float)
    scan.add_argument("--min-sloc", type=int)
    scan.add_argument("--top", type=int)
    history = verbs.add_parser("history")
    history.add_argument("--ref", default="HEAD")
    history.add_argument("--count", type=int, default=10)
    history.add_argument("--complexity-cutoffs", "--complexity-cutoff", default="10")
    for verb in (check, scan):
        verb.add_argument("--format", choices=["human", "json", "sarif"], default="human")
    history.add_argument("--format", choices=["human", "json"], default="human")
    return parser


def render(report: DataFrame, kind: str) -> str:
    """A report as text; findings are what a person reads, so they come to the driver."""
    if kind == "sarif":
        return findings.sarif_document(report)
    if kind == "json":
        return json.dumps([json.loads(x) for x in findings.ordered(report).toJSON().collect()], indent=2)
    return "\n".join(r["text"] for r in findings.human_lines(report).collect())


def run_index(spark: SparkSession, repo: Repository, ref: str, output: str, policy: policies.Policy) -> None:
    entries = repo.entries(spark, ref)
    revision = snapshot.analyze(entries)
    if bad := revision.coverage.where("status = 'failed'").first():
        raise snapshot.SnapshotError(f"{bad['path']}: {bad['detail']}")
    snapshot.write_baseline(revision, snapshot.metadata(entries), output, repo.resolve(ref), policy)


def run_check(spark: SparkSession, repo: Repository, base: str, head: str, index: str, policy: policies.Policy) -> DataFrame:
    old, old_meta, commit = snapshot.read_baseline(spark, index, policy)
    if commit != repo.resolve(base):
        raise snapshot.SnapshotError(f"the baseline is of {commit}, not of {base}")
    entries = repo.entries(spark, head)
    meta = snapshot.metadata(entries)
    moves = snapshot.manifest(old_meta, meta, repo.renames(spark, commit, repo.resolve(head)))
    return rules.evaluate(old, snapshot.analyze(entries), moves, snapshot.added_lines(old_meta, meta, moves), policy)


def run_scan(spark: SparkSession, repo: Repository, options: argparse.Namespace, policy: policies.Policy) -> DataFrame:
    if options.threshold is not None:
        policy = policy.with_rule("near_clone", similarity_threshold=options.threshold)
    if options.min_sloc is not None:
        policy = policy.with_rule("near_clone", minimum_sloc=options.min_sloc)
    entries = repo.working_tree(spark, options.no_ignore) if options.working_tree else repo.entries(spark, options.ref)
    report = findings.governed(rules.scan(filter_paths(snapshot.analyze(entries).functions, options.path), policy), policy)
    if options.top is None:
        return report
    family = report.where("properties['clone_scope'] = 'family'")
    return findings.limited(report.where("properties['clone_scope'] <> 'family'"), family, options.top)


def run_history(spark: SparkSession, repo: Repository, options: argparse.Namespace) -> str:
    cutoffs = parse_cutoffs(options.complexity_cutoffs)
    commits = repo.history(options.ref, options.count)
    entries = reduce(DataFrame.unionByName, [repo.entries(spark, c) for c in commits])
    found = {(r["revision"], r["cutoff"]): r for r in revision_summaries(entries, cutoffs).collect()}
    out = []
    for commit in commits:
        first = found.get((commit, cutoffs[0]))
        ratios = {str(c): found[commit, c]["erosion_ratio"] if (commit, c) in found else 0.0 for c in cutoffs}
        out.append({
            "commit": commit, "total_mass": first["total_mass"] if first else 0.0, "erosion_ratio": ratios[str(cutoffs[0])],
            "high_complexity_function_count": first["high_count"] if first else 0, "maximum_function_cc": first["max_cc"] if first else 0,
            "maximum_function_mass": first["max_mass"] if first else 0.0, "erosion_by_cutoff": ratios,
        })
    if options.format == "json":
        return json.dumps(out, indent=2)
    return "\n".join(f"{r['commit'][:12]} mass {r['total_mass']:.2f} erosion {100 * r['erosion_ratio']:.2f}% max CC {r['maximum_function_cc']}" for r in out)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, cwd: str = ".") -> int:
    options = _parser().parse_args(arguments)
    try:
        if options.verb == "init":
            policies.write_policy_file(options.policy, options.force)
            return 0
        policy = policies.load_policy(options.policy)
        repo = Repository(cwd)
        spark = spark or SparkSession.builder.appName("strata").getOrCreate()
        if options.verb == "index":
            run_index(spark, repo, options.ref, options.output, policy)
            return 0
        if options.verb == "history":
            print(run_history(spark, repo, options))
            return 0
        report = run_check(spark, repo, options.base, options.head, options.index, policy) if options.verb == "check" else run_scan(spark, repo, options, policy)
        print(render(report, options.format))
        return int(findings.has_errors(report))
    except (policies.PolicyError, snapshot.SnapshotError, GitError, ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
