"""Overlaps that add up inside tasks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import blocks, similarity
from strata.operators.meetings import meetings
from strata.plans import queries
from strata.policy import NearClone
from test_functions import UNIT, plain_block, unit

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_pairs_moved(monkeypatch):
    """Counting pairs by a join or storing every unit's streams fails: both grow beyond the disk."""

    def refused(*args, **options):
        raise AssertionError("all pairs shuffled, or all streams stored")

    monkeypatch.setattr(similarity, "overlaps", refused)
    monkeypatch.setattr(blocks, "overlaps", refused)
    monkeypatch.setattr(queries, "stored_units", refused)


def some_units(seed):
    rng = random.Random(seed)
    hot, rows = [[rng.getrandbits(63) for _ in range(n)] for n in (9, 3, 1)], []
    for k in range(1, 120):
        base = [rng.getrandbits(63) - (1 << 62) for _ in range(rng.randint(0, 12))]
        base += list(rng.choice(rows)[11])[:20] if rows and rng.random() < 0.4 else []
        base += [h for part in hot if rng.random() < 0.5 for h in part]
        rows.append(unit(k * 1_000_003 - 40_000_000, base, tokens=rng.choice([30, 50]), language=rng.choice("lm")))
    return rows


def plain(rows, budget):
    found = {}
    for q in rows:
        a = set(q[9])
        met = sorted((-len(a & set(c[9])), c[2], c[4], c[3], c[0]) for c in rows if c[0] < q[0] and c[1] == q[1] and a & set(c[9]))
        found |= {(q[0], m[4]): (-m[0], k) for k, m in enumerate(met[:budget], 1)}
    return found


@pytest.mark.parametrize("budget", [1, 5, 64])
def test_the_best_candidates_are_those_of_the_loops(spark, budget):
    rows = some_units(budget)
    found = meetings(spark.createDataFrame(rows, UNIT), budget).collect()
    assert found and {(r.q, r.c): (r.overlap, r.rn) for r in found} == plain(rows, budget)


def test_needs_apply_after_the_budget_and_no_budget_gives_all(spark):
    rows = some_units(7)
    units = spark.createDataFrame(rows, UNIT)
    all_pairs = {k: v[0] for k, v in plain(rows, None).items()}
    assert {(r.q, r.c): r.overlap for r in meetings(units).collect()} == all_pairs
    found = meetings(units, 4, F.when(F.col("token_count") >= 50, 3), F.when(F.col("token_count") < 50, 2)).collect()
    tokens = {r[0]: r[5] for r in rows}
    expected = {k: v for k, v in plain(rows, 4).items() if tokens[k[0]] >= 50 and tokens[k[1]] < 50 and v[0] >= 3}
    assert found and {(r.q, r.c): (r.overlap, r.rn) for r in found} == expected


def test_repeated_and_null_ids_null_languages_and_empty_tables(spark):
    one, two, three = unit(1, [1, 2, 3, 4]), unit(2, [2, 3, 9]), list(unit(3, [2, 3]))
    three[1] = None
    rows = [one, two, two, tuple(three)]
    found = meetings(spark.createDataFrame(rows, UNIT), 9).collect()
    assert [(r.q, r.c, r.overlap, r.rn) for r in found] == [(2, 1, 2, 1)]
    assert meetings(spark.createDataFrame(rows[:0], UNIT), 9).collect() == []


def test_topk_moves_no_pairs(spark, no_pairs_moved):
    assert queries.near_clone_topk(spark, SF).count() > 1000


def test_shingle_overlap_moves_no_pairs(spark, no_pairs_moved):
    assert queries.shingle_overlap(spark, SF).count() > 400


def plain_run(stream, other):
    best, k = (0, 0), 0
    while k < len(stream):
        n = 0
        while k + n < len(stream) and stream[k + n] in other:
            n += 1
        best = max(best, (n, -k))
        k += n + 1
    return -best[1], best[0]


@pytest.mark.parametrize("budget", [3, 64])
def test_runs_are_those_of_the_loops(spark, budget):
    rng = random.Random(budget)
    rows = []
    for r in some_units(budget):
        rows.append((*r[:11], list(r[11]) + rng.choices(r[11], k=rng.randint(0, 8)) if r[11] else [], *r[12:]))
    units = spark.createDataFrame(rows, UNIT)
    sized = F.when(F.col("token_count") >= 50, 1)
    by = {r[0]: r for r in rows}
    expected = {}
    for q, c in plain(rows, budget):
        start, length = plain_run(by[q][11], set(by[c][9]))
        if by[q][5] >= 50 and by[c][5] >= 50 and length >= 6:
            expected[q, c] = (start, length)
    found = meetings(units, budget, sized, sized, 6).collect()
    assert expected and {(r.q, r.c): (r.start, r.length) for r in found} == expected


def test_longest_run_moves_no_pairs(spark, no_pairs_moved):
    assert queries.block_longest_run(spark, SF).count() > 20


def test_block_matches_moves_no_pairs(spark, no_pairs_moved):
    assert queries.block_matches(spark, SF).count() > 10


@pytest.mark.parametrize("most", [1, 3])
def test_the_best_blocks_are_those_of_the_loops_where_longer_left_runs_end_early_on_the_right(spark, most):
    """Candidates that hold a query's longest run in pieces come first by left run and last by island."""
    rng, rows = random.Random(most), []
    for k in range(1, 60):
        stream = [rng.randrange(12) for _ in range(rng.randint(0, 40))]
        if k % 3 == 0:  # all shingles twice, each followed by its own
            stream = [h for x in stream[:20] for h in (x, 1000 * k + x)] + stream[:5]
        shape = [h % 5 for h in stream] if k % 4 else [-k * 100 - i for i in range(len(stream))]
        rows.append((*unit(k, stream, tokens=100)[:9], sorted(set(stream)), sorted(set(shape)), stream, shape, 10.0))
    policy = NearClone(minimum_tokens=6, block_minimum_tokens=8, block_max_families=most, block_max_candidates=100)
    expected, rounds = set(), 0
    for q in rows:
        found, lefts = [], []
        for c in rows:
            block = plain_block(q[11], c[11], 4) if c[0] < q[0] else None
            shape = plain_run(q[12], set(c[10]))[1]
            lefts += [plain_run(q[11], set(c[9]))[1]] if c[0] < q[0] else []
            if block and shape >= 4:
                found.append((-min(block[1], block[3]), c[2], c[4], c[3], c[0], *block, shape))
        best = sorted(found)[:most]
        expected |= {(q[0], *f[4:], -f[0]) for f in best}
        rounds += any(-f[0] < sorted(lefts)[-most - 1] for f in best if len(lefts) > most)
    got = blocks.block_matches(spark.createDataFrame(rows, UNIT), policy).collect()
    assert expected and rounds and {(r.q, r.c, r.left_start, r.left_length, r.right_start, r.right_length, r.ast_length, r.island) for r in got} == expected
