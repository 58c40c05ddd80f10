"""Whole matches without a count of all pairs that share a shingle, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import rules, similarity
from strata.plans import queries
from strata.policy import NearClone, Policy
from strata.session import marks
from test_functions import UNIT, unit

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_count_of_all(monkeypatch):
    """Counting or storing what every unit has fails: both grow beyond the disk."""

    def refused(*args, **options):
        raise AssertionError("all pairs counted, or all streams stored")

    monkeypatch.setattr(similarity, "overlaps", refused)
    monkeypatch.setattr(queries, "stored_units", refused)


def plain(rows, policy):
    """Query to candidate and similarity: rank all by overlap, then the floors and the threshold."""
    found = {}
    for q in rows:
        if q[5] < policy.minimum_tokens or q[6] < policy.minimum_sloc:
            continue
        a = set(q[9])
        met = sorted((-len(a & set(c[9])), c[2], c[4], c[3], c[0], c) for c in rows if c[0] < q[0] and c[1] == q[1] and a & set(c[9]))
        best = []
        for n, _, _, _, _, c in met[: policy.max_candidates]:
            s = -n / len(a | set(c[9]))
            if s >= policy.similarity_threshold and c[5] >= policy.minimum_tokens and c[6] >= policy.minimum_sloc:
                best.append((-s, c[2], c[4], c[3], c[0]))
        if best:
            found[q[0]] = (min(best)[4], pytest.approx(-min(best)[0]))
    return found


@pytest.mark.parametrize("budget", [1, 3, 64])
def test_whole_matches_are_those_of_the_loops(spark, no_count_of_all, budget):
    rng = random.Random(budget)
    hot = [7 << 40, -3, 5]
    rows = []
    for k in range(1, 90):
        base = [rng.getrandbits(63) - (1 << 62) for _ in range(rng.randint(5, 30))] + hot if k < 12 else list(rng.choice(rows)[11])
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.getrandbits(63)
        rows.append(unit(k, base + [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 60]))], tokens=rng.choice([30, 50, 50]), language=rng.choice("lm")))
    policy = NearClone(max_candidates=budget)
    found = similarity.best_whole_matches(spark.createDataFrame(rows, UNIT), policy).collect()
    assert found and {r.q: (r.c, r.similarity) for r in found} == plain(rows, policy)


@pytest.mark.parametrize("name", ["near_clone_best", "clone_families", "family_summary", "lcs_added_lines"])
def test_queries_of_whole_matches_store_no_streams(spark, no_count_of_all, name):
    assert queries.QUERIES[name](spark, SF).collect() or name == "lcs_added_lines"  # no line is added there


def test_scan_reads_units_that_share_an_identity_once(spark, no_count_of_all):
    base = list(range(20))
    rows = [unit(1, base, name="a"), unit(4, base, name="a"), unit(7, base, name="b"), unit(9, range(50, 60), name="c")]
    found = rules.scan(spark.createDataFrame(rows, UNIT), Policy().with_rule("near_clone", detect_blocks=False)).collect()
    assert sorted((r.properties["clone_scope"], r.properties.get("left"), r.properties.get("right")) for r in found) == [("family", None, None), ("whole-function", "7", "1")]


def test_marks_hold_every_hash(spark):
    rng = random.Random(1)
    values = [0, -1, 1 << 62, -(1 << 63), *[rng.getrandbits(64) - (1 << 63) for _ in range(200)]]
    some = spark.createDataFrame([(v,) for v in values], "h bigint")
    held = marks(some, 22)
    assert some.where(held(F.col("h"))).count() == len(values)
    assert spark.range(10_000).select(F.xxhash64("id").alias("h")).where(held(F.col("h"))).count() < 100
