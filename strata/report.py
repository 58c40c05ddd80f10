"""The library's report on a candidate against a baseline: findings, what was looked at, and what was not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from strata.operators import coverage, rules
from strata.policy import Policy
from strata.session import cut
from strata.sources import snapshot

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Report:
    """Tables stay distributed; ``reasons`` is empty where every rule that applies ran."""

    schema_version: int
    baseline_id: str
    candidate_id: str
    baseline_snapshot_id: str
    candidate_snapshot_id: str
    policy_fingerprint: str
    analyzer_fingerprint: str
    findings: DataFrame
    coverage: DataFrame
    rule_coverage: DataFrame
    reasons: DataFrame

    @property
    def complete(self) -> bool:
        return self.reasons.isEmpty()


def evaluate(
    baseline: tuple[rules.Revision, DataFrame, str], entries: DataFrame, candidate_id: str, policy: Policy,
    renames: DataFrame | None = None, declared: DataFrame | None = None, **diff_options,
) -> Report:
    """A report on ``entries`` against what :func:`snapshot.read_baseline` gave.

    ``declared`` is a manifest from elsewhere, which must agree with the snapshots.
    A line diff over its budget fails the rules on added lines for its path, and
    erosion for all, instead of the whole report.
    """
    old, old_meta, baseline_id = baseline
    if not candidate_id.strip():
        raise snapshot.SnapshotError("the candidate has no id")
    snapshot.validate_entries(entries)
    meta = cut(snapshot.metadata(entries))
    if declared is not None:
        renames = declared.where("old_path is not null").select("path", "old_path")
    moves = cut(snapshot.manifest(old_meta, meta, renames))
    if declared is not None:
        snapshot.validate_manifest(declared, moves, old_meta)
    head = snapshot.analyze(entries)
    lines, over = snapshot.line_diffs(old_meta, meta, moves, **diff_options)
    erosion = rules.erosion_can_run(head, over)
    changed = moves.where("status in ('added', 'changed')").select("path")
    ran = cut(coverage.rule_coverage(head.coverage, policy.severities(), over, changed, erosion))
    return Report(
        SCHEMA_VERSION, baseline_id, candidate_id, snapshot.fingerprint(old_meta), snapshot.fingerprint(meta), policy.fingerprint(), snapshot.analyzer_fingerprint(),
        rules.evaluate(old, head, moves, lines, policy, erosion), head.coverage.drop("rev_id"), ran, coverage.incomplete_reasons(ran),
    )
