"""The library's report, baseline validation, and sums over ranges."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from strata.operators import coverage
from strata.policy import Policy
from strata.report import evaluate
from strata.sources import snapshot

OLD = {"src/a.rs": "fn f(x: u8) -> u8 {\n    x\n}\n", "src/b.rs": "#[allow(dead_code)]\nfn g() {}\n", "b.py": "def h():\n    pass\n", "Cargo.toml": '[dependencies]\nserde = "1"\n', "notes.txt": "x\n"}


def baseline(spark, tmp_path, files=OLD, kind="parquet"):
    entries = snapshot.from_rows(spark, "r1", files)
    path = str(tmp_path / f"base-{kind}")
    snapshot.write_baseline(snapshot.analyze(entries), snapshot.metadata(entries), path, "r1", Policy(), kind)
    return snapshot.read_baseline(spark, path, Policy(), kind)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_json_baseline_holds_what_the_parquet_one_does(spark, tmp_path):
    one, two = baseline(spark, tmp_path), baseline(spark, tmp_path, kind="json")
    assert one[2] == two[2] == "r1" and snapshot.fingerprint(one[1]) == snapshot.fingerprint(two[1])
    for name in snapshot.TABLES:
        a, b = getattr(one[0], name), getattr(two[0], name)
        assert a.schema == b.schema and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_a_complete_report(spark, tmp_path):
    base = baseline(spark, tmp_path)
    new = {**OLD, "src/a.rs": "fn f(x: u8) -> u8 {\n    unsafe { y() }\n}\n", "Cargo.toml": '[dependencies]\nserde = "1"\nrand = "1"\n'}
    report = evaluate(base, snapshot.from_rows(spark, "r2", new), "r2", Policy())
    assert report.complete and (report.baseline_id, report.candidate_id) == ("r1", "r2")
    assert report.baseline_snapshot_id != report.candidate_snapshot_id and len(report.policy_fingerprint) == len(report.analyzer_fingerprint) == 64
    assert {"unsafe-surface-growth", "dependency-surface-growth"} <= {r.rule_id for r in report.findings.collect()}
    assert rows(report.coverage, "path", "status")[-1] == ("src/b.rs", "analyzed") and report.coverage.count() == len(new)
    ran = {(r.path, r.rule_id): r.status for r in report.rule_coverage.collect()}
    assert len(ran) == 6 * len(new)
    assert ran["src/a.rs", "function-mass"] == "completed" and ran["src/b.rs", "function-mass"] == "not-applicable" and ran["src/b.rs", "structural-erosion"] == "completed"


def test_a_file_that_fails_leaves_the_report_incomplete(spark, tmp_path):
    base = baseline(spark, tmp_path)
    report = evaluate(base, snapshot.from_rows(spark, "r2", {**OLD, "src/b.rs": "fn g( {\n"}), "r2", Policy())
    assert not report.complete and [(r.kind, r.first_path) for r in report.reasons.collect()] == [("analysis-failed", "src/b.rs")]
    assert "structural-erosion" not in {r.rule_id for r in report.findings.collect()}
    ran = {(r.path, r.rule_id): r for r in report.rule_coverage.collect()}
    assert not ran["src/a.rs", "structural-erosion"].completed and ran["src/b.rs", "near-clone"].status == "failed"


def test_a_diff_over_its_budget_fails_its_rules_alone(spark, tmp_path):
    base = baseline(spark, tmp_path)
    new = {**OLD, "src/a.rs": "fn z() {}\n#[allow(dead_code)]\nfn f(x: u8) -> u8 {\n    1\n}\n", "src/b.rs": "#[allow(dead_code)]\nfn g() {}\n#[allow(unused)]\nfn k() {}\n"}
    entries = snapshot.from_rows(spark, "r2", new)
    report = evaluate(base, entries, "r2", Policy(), budget=12)
    assert [(r.kind, r.first_path) for r in report.reasons.collect()] == [("budget-exceeded", "src/a.rs")]
    ran = {(r.path, r.rule_id): r.status for r in report.rule_coverage.collect()}
    assert ran["src/a.rs", "lint-suppression-growth"] == "failed" and ran["src/a.rs", "function-mass"] == "completed" and ran["src/b.rs", "lint-suppression-growth"] == "completed"
    assert {r.path for r in report.findings.where("rule_id = 'lint-suppression-growth'").collect()} == {"src/b.rs"}
    assert evaluate(base, entries, "r2", Policy()).complete
    metas = [base[1], snapshot.metadata(entries)]
    with pytest.raises(snapshot.SnapshotError, match="src/a.rs"):
        snapshot.added_lines(*metas, snapshot.manifest(*metas), budget=12)


def test_a_declared_manifest_must_agree(spark, tmp_path):
    base = baseline(spark, tmp_path)
    new = {k: v for k, v in OLD.items() if k != "b.py"} | {"c.py": OLD["b.py"]}
    entries = snapshot.from_rows(spark, "r2", new)
    declare = lambda *r: spark.createDataFrame(list(r), "path string, status string, old_path string")
    assert evaluate(base, entries, "r2", Policy(), declared=declare(("c.py", "changed", "b.py"))).complete
    assert evaluate(base, entries, "r2", Policy(), declared=declare(("c.py", "added", None), ("b.py", "deleted", None))).complete
    for wrong in (declare(("c.py", "changed", "lost.py")), declare(("c.py", "changed", "b.py"), ("src/a.rs", "changed", None)), declare(("c.py", "changed", "c.py"))):
        with pytest.raises(snapshot.SnapshotError):
            evaluate(base, entries, "r2", Policy(), declared=wrong)
    with pytest.raises(snapshot.SnapshotError):
        evaluate(base, entries, " ", Policy())


@pytest.mark.parametrize(
    "table, change, fault",
    [
        ("functions", lambda d: d.withColumn("path", F.lit("notes.txt")), "functions: a fact has no such place"),
        ("functions", lambda d: d.withColumn("start_line", F.lit(0)), "functions: a fact has no such place"),
        ("lints", lambda d: d.withColumn("line", F.lit(99)), "lints: a fact has no such place"),
        ("dependencies", lambda d: d.withColumn("dependency_key", F.lit("")), "dependencies: a fact has no such place"),
        ("coverage", lambda d: d.where("path <> 'b.py'"), "coverage does not match the entries"),
        ("coverage", lambda d: d.unionByName(d.withColumn("path", F.lit("new"))), "coverage does not match the entries"),
        ("coverage", lambda d: d.withColumn("status", F.when(F.col("path") == "b.py", "failed").otherwise(F.col("status"))).withColumn("detail", F.lit("gone")), "failed: gone"),
    ],
)
def test_unsound_baselines_are_refused(spark, tmp_path, table, change, fault):
    entries = snapshot.from_rows(spark, "r1", OLD)
    revision, meta = snapshot.analyze(entries), snapshot.metadata(entries)
    snapshot.validate_baseline(revision, meta, Policy())
    bad = dataclasses.replace(revision, **{table: change(getattr(revision, table))})
    assert fault in {r.fault for r in snapshot.baseline_faults(bad, meta, Policy()).collect()}
    with pytest.raises(snapshot.SnapshotError, match="not sound"):
        snapshot.validate_baseline(bad, meta, Policy())


def test_a_baseline_of_other_extractors_is_refused(spark, tmp_path, monkeypatch):
    baseline(spark, tmp_path)
    monkeypatch.setattr(snapshot, "analyzer_fingerprint", lambda: "0" * 64)
    with pytest.raises(snapshot.SnapshotError, match="other extractors"):
        snapshot.read_baseline(spark, str(tmp_path / "base-parquet"), Policy())


def test_sums_and_neighbours_do_not_depend_on_ranges(spark):
    many = spark.range(500).select("id", (F.col("id") % 7).alias("size"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    plain = {None: [0, 0], 1: [0, 0], 2: [0, 0], "all": [0, 0]}
    want, want_all = [], []
    for i in range(500):
        for key, out in ((i % 3 or None, want), ("all", want_all)):
            plain[key][0] += i % 7
            plain[key][1] += 1
            out.append((i, *plain[key], "analyzed" if plain[key][0] <= 300 and plain[key][1] <= 400 else "failed"))
    shown = ("id", "running_bytes", "file_index", "status")
    assert rows(coverage.within_budget(many, "id", F.col("size"), 300, 400, ["g"]), *shown) == want
    assert rows(coverage.within_budget(many, "id", F.col("size"), 300, 400), *shown) == want_all
    sorted_rows = spark.range(500).select("id", F.when(F.col("id") == 250, 10).otherwise(F.col("id")).alias("k"))
    assert rows(coverage.unsorted(sorted_rows, "k", "id"), "id") == [(250,)]
    assert rows(coverage.within_budget(many.limit(0), "id", F.col("size"), 1, 1), *shown) == [] == coverage.unsorted(sorted_rows.limit(0), "k", "id").collect()
