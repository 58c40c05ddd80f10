"""Small cases of the core's functions and operators, below, at and above each limit."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import blocks, changes, coverage, families, findings, metrics, similarity
from strata.operators.graph import connected_components
from strata.policy import NearClone, Policy, PolicyError, Suppression, is_object_id, is_relative_path, parse_policy, render_policy


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_line_diff_over_a_small_domain():
    sequences = [s for n in range(5) for s in itertools.product((1, 2, 3), repeat=n)]
    for a in sequences:
        for b in sequences:
            added = changes.added_line_numbers(list(a), list(b))
            kept = [x for i, x in enumerate(b, 1) if i not in added]
            assert len(kept) == lcs_length(a, b) and added == sorted(set(added))
            rest = iter(a)
            assert all(any(x == y for y in rest) for x in kept)


def test_line_diff_budget_and_long_inputs():
    assert changes.added_line_numbers([1, 2, 3], [4, 5, 6], budget=16) == [1, 2, 3]
    with pytest.raises(changes.BudgetExceeded):
        changes.added_line_numbers([1, 2, 3], [4, 5, 6], budget=15)
    long = list(range(4_000))
    assert changes.added_line_numbers(long, [*long[:2_000], -1, *long[2_000:]]) == [2_001]


def test_text_functions(spark):
    rows = [(None,), ("",), (" a\n",), ("One  two\nthree 4x",), ("a\nb\n",), ("x! y? z.",)]
    df = spark.createDataFrame(rows, "text string").withColumn("t", T.words(F.col("text")))
    got = df.select("t", T.code_lines(F.col("text")), T.sentence_ends(F.col("text")), F.size(T.line_hashes(F.col("text")))).collect()
    assert [r[0] for r in got] == [[], [], ["a"], ["one", "two", "three", "4x"], ["a", "b"], ["x!", "y?", "z."]]
    assert [r[1] for r in got] == [0, 0, 1, 2, 2, 1]
    assert [r[2] for r in got] == [0, 0, 0, 0, 0, 3]
    assert [r[3] for r in got][1:] == [0, 1, 2, 2, 1]
    arrays = spark.createDataFrame([([],), ([1],), ([1, 1, 2, 2, 2, 1],), ([5, 5],)], "v array<int>").withColumn("r", T.run_lengths(F.col("v")))
    out = arrays.select("r", T.from_run_lengths(F.col("r")).alias("b"), "v").collect()
    assert [[tuple(x) for x in r.r] for r in out] == [[], [(1, 1)], [(2, 1), (3, 2), (1, 1)], [(2, 5)]]
    assert all(list(r.b) == list(r.v) for r in out)
    leaves = spark.createDataFrame([("foo",), ("9x",), ("'s'",), ("+",), ("_a",)], "t string").select(T.normalized_leaf(F.col("t"))).collect()
    assert [r[0] for r in leaves] == ["ID", "LIT", "LIT", "+", "ID"]
    hexes = spark.createDataFrame([([0, 255, 4294967295],), ([],)], "v array<bigint>").withColumn("h", T.hex_sequence(F.col("v")))
    back = hexes.select("h", T.from_hex_sequence(F.col("h"))).collect()
    assert back[0][0] == "00000000000000ffffffffff" and back[0][1] == [0, 255, 4294967295] and back[1][1] == []


def test_paths_and_ids(spark):
    paths = ["a/b.rs", "/a", "a//b", "a/../b", "./a", "a\\b", "a", ""]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(T.relative_path(F.col("p"))).collect()]
    assert got == [is_relative_path(p) for p in paths] == [True, False, False, False, False, False, True, False]
    assert is_object_id("a" * 40) and is_object_id("F" * 64) and not is_object_id("a" * 41) and not is_object_id("g" * 40)


def test_policy():
    assert parse_policy(b"  ") == Policy() and Policy().near_clone.block_tokens == 120 and Policy().near_clone.block_run == 116
    full = Policy(suppressions=(Suppression("near-clone", "a.rs", "why", 3),))
    assert parse_policy(render_policy(full)) == full and full.fingerprint() != Policy().fingerprint()
    bad = [
        "version = 2", "x = 1", "[rules.near_clone]\nsimilarity_threshold = 1.1", "[rules.near_clone]\nminimum_tokens = 5", "[rules.function_mass]\nseverity = 'loud'",
        "[rules.structural_erosion]\ntop_contributors = 11", "[rules.function_mass]\ndelta_limit = -1.0", "[[suppressions]]\nrule = 'near-clone'\npath = '/a'\nreason = 'x'",
        "[[suppressions]]\nrule = 'near-clone'\npath = 'a'\nreason = ' '", "[[suppressions]]\nrule = 'near-clone'\npath = 'a'\nline = 0\nreason = 'x'", "not toml", "[rules.unknown]\na = 1",
    ]
    for text in bad:
        with pytest.raises(PolicyError):
            parse_policy(text)


def test_components_match_a_plain_search(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def unit(pos, shingles, tokens=50, sloc=10, role="general", language="l", name=None, hashed=None):
    seq = list(shingles)
    return (pos, language, f"p{pos % 3}", name or f"n{pos}", 1, tokens, sloc, role, hashed or f"h{pos}", sorted(set(seq)), sorted(set(seq)), seq, seq, float(sloc))


UNIT = (
    "pos bigint, language string, path string, qualified_name string, start_line int, token_count int, sloc int, role string, normalized_hash string, "
    "shingles array<bigint>, ast_shingles array<bigint>, shingle_seq array<bigint>, ast_shingle_seq array<bigint>, mass double"
)


def test_whole_matches_at_the_limits(spark):
    base = list(range(20))
    rows = [
        unit(1, base), unit(2, [*base[:17], 90, 91, 92], tokens=40, sloc=8), unit(3, base[:17], tokens=39), unit(4, base, sloc=7), unit(5, base, language="m"),
        unit(6, [*base, 95], tokens=41), unit(7, [], hashed="same"), unit(8, [], hashed="same"),
    ]
    got = {(r.q, r.c): r.similarity for r in similarity.best_whole_matches(spark.createDataFrame(rows, UNIT)).collect()}
    assert got == {(6, 1): pytest.approx(20 / 21)}
    loose = NearClone(similarity_threshold=17 / 23)
    assert (2, 1) in {(r.q, r.c) for r in similarity.best_whole_matches(spark.createDataFrame(rows, UNIT), loose).collect()}


def test_candidate_budget_comes_before_the_floors(spark):
    rows = [unit(k, range(20), sloc=1, name=f"a{k}") for k in range(1, 4)] + [unit(4, range(19), name="z"), unit(5, range(20), name="q")]
    df = spark.createDataFrame(rows, UNIT)
    assert similarity.best_whole_matches(df, NearClone(max_candidates=3)).collect() == []
    assert [(r.q, r.c) for r in similarity.best_whole_matches(df, NearClone(max_candidates=4)).collect()] == [(5, 4)]


def plain_block(q, c, minimum):
    def runs(walk, has, starts=None):
        best = (0, 0)
        for i in starts if starts is not None else range(len(walk)):
            if starts is None and i and walk[i - 1] in has:
                continue
            n = 0
            while i + n < len(walk) and walk[i + n] in has:
                n += 1
            if n > best[1]:
                best = (i, n)
        return best

    left = runs(q, set(c))
    if left[1] < minimum:
        return None
    anchors = [i for i, x in enumerate(c) if x == q[left[0]]][:8]
    right = runs(c, set(q), anchors)
    return (*left, *right) if right[1] >= minimum else None


def test_blocks_match_the_loops(spark):
    rng = random.Random(12)
    rows = [unit(k, [rng.randrange(9) for _ in range(rng.randint(0, 25))], tokens=100) for k in range(1, 25)]
    policy = NearClone(minimum_tokens=6, block_minimum_tokens=8, block_max_families=100)
    got = {(r.q, r.c): (r.left_start, r.left_length, r.right_start, r.right_length) for r in blocks.block_matches(spark.createDataFrame(rows, UNIT), policy).collect()}
    want = {(a[0], b[0]): plain_block(a[11], b[11], 4) for a in rows for b in rows if b[0] < a[0]}
    assert got == {k: v for k, v in want.items() if v}


def test_family_summary(spark):
    df = spark.createDataFrame([unit(1, [1], role="test"), unit(2, [1]), unit(3, [1]), unit(4, [2])], UNIT)
    edges = spark.createDataFrame([(2, 1), (3, 2)], "q bigint, c bigint")
    groups = families.clone_families(edges, df)
    assert sorted(map(tuple, groups.collect())) == [(1, 1), (1, 2), (1, 3), (4, 4)]
    row = families.family_summary(groups, df, edges.where("q = 2")).first()
    assert (row.members, row.family_mass, row.recoverable_mass, row.roles, row.risk, row.has_block) == (3, 30.0, 20.0, "general,test", "medium", True)


def test_metrics_at_the_limits(spark):
    df = spark.createDataFrame([(10, 2.0), (11, 3.0)], "cc int, mass double")
    rows = {r.cutoff: r for r in metrics.summaries(df, [9, 10, 11], []).collect()}
    assert [rows[c].high_count for c in (9, 10, 11)] == [2, 1, 0] and rows[10].erosion_ratio == pytest.approx(0.6) and rows[11].erosion_ratio == 0.0
    growth = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 3.0)], "b double, h double").select(metrics.mass_growth(F.col("b"), F.col("h"))).collect()
    assert [r[0] for r in growth] == [0.0, 1.0, 0.5]
    limits = spark.createDataFrame([(0.08, 0.08, 0.5), (0.09, 0.09, 0.51)], "g double, d double, r double")
    got = [r[0] for r in limits.select(metrics.breaches(F.col("g"), F.col("d"), F.col("r"), 0.08, 0.08, 0.5)).collect()]
    assert got == ["", "mass-growth,ratio-delta,ratio-level"]
    values = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3]] + [(None,)], "v double").withColumn("k", F.lit(1))
    row = metrics.floor_quantiles(values, "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}, ["k"]).first()
    assert (row.n, row.p50, row.p95, row.p100) == (5, 3.0, 4.0, 5.0)


def test_bag_difference_matches_the_greedy_loop(spark):
    rng = random.Random(7)
    for _ in range(4):
        head = [(rng.choice("ab"), rng.choice("xy"), n) for n in rng.sample(range(20), 9)]
        base = [(rng.choice("ab"), rng.choice("xy"), n) for n in rng.sample(range(20), 9)]
        frames = [spark.createDataFrame(x, "p string, f string, line int") for x in (head, base)]
        got = changes.bag_difference(*frames, ["p", "f"], ["p", "line"], ["line"]).collect()
        left, rest = sorted(base, key=lambda r: r[2]), []
        for h in sorted(head, key=lambda r: r[2]):
            hit = next((b for b in left if b[:2] == h[:2]), None)
            left.remove(hit) if hit else rest.append(h)
        out = []
        for h in rest:
            hit = next((b for b in left if (b[0], b[2]) == (h[0], h[2])), None)
            left.remove(hit) if hit else out.append(h)
        assert sorted(map(tuple, got)) == sorted(out)


def test_hunks_and_entry_diff(spark):
    patch = "@@ -1,2 +3,2 @@ fn a\n+x\n@@ -9 +10 @@\n+y\n@@ -20,3 +30,0 @@\n"
    lines = changes.hunk_lines(spark.createDataFrame([("a.rs", patch)], "path string, text string"), "path", "text")
    assert sorted(r.line for r in lines.collect()) == [3, 4, 10]
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("same", 1), ("gone", 1), ("was", 1), ("null", None)], [("same", 1), ("new", 1), ("was", 2), ("null", None)]))
    assert sorted(map(tuple, changes.entry_diff(a, b, "k", ["v"]).collect())) == [("gone", "deleted"), ("new", "added"), ("was", "changed")]


def test_suppressions_and_severity(spark):
    rows = spark.createDataFrame([("near-clone", "a", 1), ("near-clone", "a", 2), ("near-clone", "b", 1), ("analysis-error", "a", 1)], "r string, p string, l int")
    found = findings.shaped(rows, rule_id=F.col("r"), path=F.col("p"), line=F.col("l"), severity=F.lit("warning"), message=F.lit("m"), emit_seq=F.lit(1))
    policy = parse_policy('[rules.near_clone]\nseverity = "error"\n[[suppressions]]\nrule = "near-clone"\npath = "a"\nline = 2\nreason = "x"\n[[suppressions]]\nrule = "near-clone"\npath = "b"\nreason = "x"\n')
    kept = findings.governed(found, policy)
    assert [(r.rule_id, r.line, r.severity) for r in kept.collect()] == [("analysis-error", 1, "warning"), ("near-clone", 1, "error")]
    assert findings.has_errors(kept)
    assert [r.text for r in findings.human_lines(kept).collect()] == ["a:1: warning[analysis-error]: m", "a:1: error[near-clone]: m"]


def test_coverage_budget_and_paths(spark):
    files = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "path string, n int")
    assert [r.status for r in coverage.within_budget(files, "path", F.col("n"), 10, 9).orderBy("path").collect()] == ["analyzed", "failed", "failed"]
    paths = spark.createDataFrame([("src/a.rs",), ("src2/b.rs",)], "path string")
    assert [r.path for r in coverage.filter_paths(paths, ["src/"]).collect()] == ["src/a.rs"]
    with pytest.raises(ValueError):
        coverage.filter_paths(paths, ["lib"])
    reasons = spark.createDataFrame([("b", "failed", "x"), ("a", "failed", "budget"), ("c", "failed", "x"), ("d", "analyzed", "")], "path string, status string, detail string")
    assert [(r.kind, r.n) for r in coverage.incomplete_reasons(reasons).collect()] == [("budget-exceeded", 1), ("analysis-failed", 2)]
    assert not coverage.unsorted(spark.createDataFrame([(1, "b"), (2, "a")], "o int, k string"), "k", "o").isEmpty()


def test_similar_pairs_are_those_of_a_plain_comparison(spark):
    rng = random.Random(7)
    sets, edited = [], []
    for size in (*range(0, 24), 60, 61, 120, 300):
        first = rng.sample(range(-10**6, 10**6), size)
        sets.append(first)
        for change in (0, 1, size // 20, size // 12, size // 10):
            gone = set(rng.sample(first, min(change, size)))
            edited.append([x for x in first if x not in gone] + rng.sample(range(2 * 10**6, 3 * 10**6), rng.choice((0, change))))
    rows = [(i, f"l{i % 2}" if i % 11 == 0 else "l0", sorted(s)) for i, s in enumerate(sets + edited)]
    units = spark.createDataFrame(rows, "pos bigint, language string, shingles array<bigint>")
    for threshold in (0.5, 0.85, 1.0):
        want = []
        for q, lq, a in rows:
            for c, lc, b in rows[:q]:
                both = len(set(a) & set(b))
                if lq == lc and both and both / (len(a) + len(b) - both) >= threshold:
                    want.append((q, c, both))
        got = similarity.similar_pairs(units, threshold).collect()
        assert len(want) > 20 and sorted((r.q, r.c, r.overlap) for r in got) == want
