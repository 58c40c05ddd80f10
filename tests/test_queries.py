"""Every driver query of the core against its SQL, and what its plan must not hold."""

import json
import subprocess
import sys

import pytest

from oracle import assert_same, connect
from strata.plans import oracles, queries, rule_oracles, rule_queries

QUERIES = queries.QUERIES | rule_queries.QUERIES
ORACLES = oracles.ORACLES | rule_oracles.ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_sarif_results_hold_every_finding(spark):
    want = sorted((r.rule_id, r.message, r.path) for r in queries._emitted(spark, SF).collect())
    found = [json.loads(r.result) for r in QUERIES["sarif_json"](spark, SF).collect()]
    assert want and sorted((f["ruleId"], f["message"]["text"], f["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for f in found) == want
    related = sum(r.base_path is not None for r in queries._emitted(spark, SF).collect())
    assert sum("relatedLocations" in f for f in found) == related


def test_added_lines_are_what_a_longest_common_subsequence_leaves(spark, duck):
    """Every pair's added lines, by a plain table of subsequence lengths over the lines themselves."""
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    pairs = duck.execute(f"SELECT doc_id, other_id FROM ({ORACLES['near_clone_best']})").fetchall()
    added = {}
    for r in QUERIES["lcs_added_lines"](spark, SF).collect():
        assert r.status == "ok"
        added.setdefault(r.doc_id, set()).add(r.line)
    assert pairs and set(added) <= {q for q, _ in pairs}
    for q, c in pairs:
        head, base = texts[q].split("\n"), texts[c].split("\n")
        kept = [x for at, x in enumerate(head, 1) if at not in added.get(q, set())]
        row = [0] * (len(base) + 1)
        for x in head:
            row, before = [0], row
            for j, y in enumerate(base):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        rest = iter(base)
        assert len(kept) == row[-1] and all(x in rest for x in kept)


def test_only_queries_beyond_sql_lack_it():
    assert set(QUERIES) - set(ORACLES) == {"lcs_added_lines", "sarif_json"} and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["near_clone_pairs", "mass_summary", "erosion_history", "bag_difference", "contamination_containment", "entry_diff"])
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_scans_read_only_their_columns(spark):
    plan = QUERIES["top_contributors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    plan = QUERIES["interval_contains"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "GreaterThan(value,90.0)" in plan


@pytest.mark.parametrize("name", ["near_clone_topk", "block_matches", "clone_families"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_entry_imports_without_the_pipeline():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('strata.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'near_clone_best' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
    )
    root = __file__.rsplit("/tests/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
