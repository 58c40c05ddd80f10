"""The whole gate over small repositories and snapshots."""

import json
import subprocess

import pytest

from strata import cli
from strata.operators import findings, rules
from strata.policy import Policy, parse_policy
from strata.sources import snapshot

BODY = """
pub fn {name}({a}: &[u32], {b}: u32) -> u32 {{
    let mut {t} = {n};
    for {i} in {a}.iter() {{
        if *{i} > {b} && {t} < 1000 {{
            {t} += *{i} * 2;
        }} else if *{i} == {b} {{
            {t} += 1;
        }}
        while {t} % 7 == 3 {{
            {t} -= 1;
        }}
    }}
    match {t} {{
        0 => {b},
        1 => {b} + 1,
        _ => {t},
    }}
}}
"""


def clone(name, a="xs", b="limit", t="total", i="x", n=0):
    return BODY.format(name=name, a=a, b=b, t=t, i=i, n=n)


def evaluate(spark, old, new, policy=None, renames=None):
    entries = [snapshot.from_rows(spark, rev, files) for rev, files in (("a", old), ("b", new))]
    base, head = (snapshot.analyze(e) for e in entries)
    metas = [snapshot.metadata(e) for e in entries]
    moved = spark.createDataFrame(renames, "path string, old_path string") if renames else None
    moves = snapshot.manifest(*metas, moved)
    return rules.evaluate(base, head, moves, snapshot.added_lines(*metas, moves), policy or Policy()).collect()


def test_renamed_copies_are_clones_and_one_family(spark):
    files = {f"src/m{k}.rs": clone(f"work{k}", f"a{k}", f"b{k}", f"t{k}", f"i{k}", k) for k in range(6)}
    files["src/other.rs"] = "pub fn plain(a: u8) -> u8 {\n" + "".join(f"    let v{k} = call_{k}(a)[{k}];\n" for k in range(12)) + "    v1\n}\n"
    functions = snapshot.analyze(snapshot.from_rows(spark, "r", files)).functions
    report = findings.ordered(rules.scan(functions, Policy())).collect()
    scopes = [r.properties["clone_scope"] for r in report]
    assert scopes.count("whole-function") == 5 and scopes.count("family") == 1 and len(scopes) == 6
    assert all(r.similarity == 1.0 for r in report if r.similarity is not None)
    family = next(r for r in report if r.properties["clone_scope"] == "family")
    assert family.properties["member_count"] == "6" and family.properties["clone_risk"] == "high"
    top = findings.limited(rules.scan(functions, Policy()).where("properties['clone_scope'] <> 'family'"), rules.scan(functions, Policy()).where("properties['clone_scope'] = 'family'"), 2)
    assert top.count() == 3
    with pytest.raises(ValueError):
        findings.limited(top, top, 0)


def test_block_inside_different_functions(spark):
    island = "".join(f"    let step{k} = compute{k}(input, {k}) + offset * {k};\n    if step{k} > 3 {{ record(step{k}); }}\n" for k in range(12))
    one = "pub fn first(input: u32) -> u32 {\n" + "".join(f"    while check_{k}(input) {{ loop {{ break; }} }}\n" for k in range(30)) + island + "    1\n}\n"
    two = "pub fn second(other: &str, input: u32) {\n" + "".join(f"    emit(other, [{k}, {k}], |z| z);\n" for k in range(30)) + island + "}\n"
    functions = snapshot.analyze(snapshot.from_rows(spark, "r", {"a.rs": one, "b.rs": two})).functions
    report = rules.scan(functions, Policy()).collect()
    blocks = [r for r in report if r.properties["clone_scope"] == "block"]
    assert len(blocks) == 1 and blocks[0].path == "b.rs" and blocks[0].base_path == "a.rs"
    assert blocks[0].line in range(31, 35) and blocks[0].base_line in range(31, 35)
    assert not [r for r in report if r.properties["clone_scope"] == "whole-function"]


def test_mass_lint_unsafe_dependency_and_erosion(spark):
    old = {
        "src/a.rs": "pub fn small(x: u8) -> u8 { x }\n#[allow(dead_code)]\nfn quiet() { let a = 1; }\nfn raw() {\n    unsafe { one() }\n}\n",
        "Cargo.toml": '[dependencies]\nserde = "1"\nlog = { version = "1", features = ["a"] }\n',
    }
    heavy = "pub fn small(x: u8) -> u8 {\n" + "".join(f"    if x == {k} {{ return call{k}(x); }}\n" for k in range(30)) + "    x\n}\n"
    new = {
        "src/a.rs": heavy + "#[allow(dead_code, unused)]\nfn quiet() { let a = 1; }\n#[expect(unused)]\nfn more() { let b = 2; }\nfn raw() {\n    unsafe { one() }\n    unsafe { two() }\n}\n",
        "Cargo.toml": '[dependencies]\nserde = "2"\nlog = { version = "1", features = ["a", "b"] }\nrand = "1"\n[dev-dependencies]\nx = "1"\n',
        "bad.py": "def broken(:\n",
    }
    got = evaluate(spark, old, new)
    by = {}
    for r in got:
        by.setdefault(r.rule_id, []).append(r)
    assert [r.delta > 20 for r in by["function-mass"]] == [True] and by["function-mass"][0].base_line == 1
    assert sorted(r.message for r in by["lint-suppression-growth"]) == ["lint suppression broadened", "new lint suppression introduced"]
    assert [r.message for r in by["unsafe-surface-growth"]] == ["new unsafe-block introduced"]
    assert sorted(r.properties["dependency"] for r in by["dependency-surface-growth"]) == ["log", "rand"]
    assert by["structural-erosion"][0].properties["breaches"] == "mass-growth,ratio-delta,ratio-level"
    assert by["structural-erosion"][0].path == "src/a.rs" and by["structural-erosion"][0].properties["contributor_1_qualified_name"] == "small"
    assert [r.path for r in by["analysis-error"]] == ["bad.py"]
    assert all(r.severity == "warning" for r in got)
    assert got == sorted(got, key=lambda r: (r.path, r.line, r.rule_id))
    strict = parse_policy('[rules.function_mass]\nseverity = "error"\n[rules.structural_erosion]\nseverity = "off"\n[[suppressions]]\nrule = "unsafe-surface-growth"\npath = "src/a.rs"\nreason = "reviewed"\n')
    kinds = {(r.rule_id, r.severity) for r in evaluate(spark, old, new, strict)}
    assert ("function-mass", "error") in kinds and not {"structural-erosion", "unsafe-surface-growth"} & {k for k, _ in kinds}


def test_moves_and_renames_are_no_growth(spark):
    old = {"src/a.rs": clone("work"), "src/b.rs": "fn x() {}\n"}
    assert evaluate(spark, old, {"src/c.rs": clone("work"), "src/b.rs": "fn x() {}\n"}, renames=[("src/c.rs", "src/a.rs")]) == []
    moved = evaluate(spark, old, {"src/c.rs": clone("work"), "src/b.rs": "fn x() {}\n"})
    assert not [r for r in moved if r.rule_id == "near-clone"]
    copied = evaluate(spark, old, {**old, "src/c.rs": clone("again")})
    assert [(r.rule_id, r.base_path) for r in copied] == [("near-clone", "src/a.rs")]


def test_command_line(spark, tmp_path, capsys):
    def git(*arguments):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *arguments], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.rs").write_text(clone("work"))
    git("add", ".")
    git("commit", "-qm", "one")
    policy = str(tmp_path / "p.toml")
    run = lambda *a: cli.main(["--policy", policy, *a], spark, str(tmp_path))
    assert run("init") == 0 and run("init") == 2 and run("init", "--force") == 0
    index = str(tmp_path / "index")
    assert run("index", "--output", index) == 0
    (tmp_path / "b.rs").write_text(clone("copy", "q", "w", "e", "r"))
    git("add", ".")
    git("commit", "-qm", "two")
    capsys.readouterr()
    assert run("check", "--base", "HEAD~1", "--index", index, "--format", "json") == 0
    assert [f["rule_id"] for f in json.loads(capsys.readouterr().out)] == ["near-clone"]
    assert run("check", "--base", "HEAD", "--index", index) == 2
    capsys.readouterr()
    assert run("scan", "--format", "sarif", "--path", "b.rs") == 0
    assert json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert run("scan", "--path", "nowhere") == 2
    capsys.readouterr()
    assert run("history", "--count", "5", "--complexity-cutoffs", "3,10", "--format", "json") == 0
    entries = json.loads(capsys.readouterr().out)
    assert len(entries) == 2 and entries[1]["total_mass"] == pytest.approx(2 * entries[0]["total_mass"])
    assert set(entries[0]["erosion_by_cutoff"]) == {"3", "10"}
