import random

import pytest

from strata.operators import changes
from strata.sources import snapshot


def test_long_files_with_distant_edits_fit_the_budget():
    long = list(range(10_000))
    assert changes.added_line_numbers(long, [-1, *long[1:]], budget=50_005) == [1]
    edited = [-1, *long[1:5_000], -2, *long[5_000:-1], -3]
    assert changes.added_line_numbers(long, edited) == [1, 5_001, 10_001]
    with pytest.raises(changes.BudgetExceeded):
        changes.added_line_numbers(long, [-1 - x for x in long])


def plain(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    i = j = 0
    added = []
    while j < len(b):
        if i < len(a) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i < len(a) and t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            added.append(j + 1)
            j += 1
    return added


def test_band_gives_the_lines_of_the_full_table():
    rng = random.Random(4)
    for _ in range(1_500):
        a = [rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 8)):
            b.insert(rng.randint(0, len(b)), rng.randrange(6))
        assert changes.added_line_numbers(a, b) == plain(a, b)


def test_budget_rows_fail_the_snapshot_diff(spark):
    schema = "path string, line_hashes array<bigint>"
    base = spark.createDataFrame([("p", list(range(6_000)))], schema)
    head = spark.createDataFrame([("p", list(range(10_000, 16_000)))], schema)
    moves = spark.createDataFrame([("p", "changed", None)], "path string, status string, old_path string")
    with pytest.raises(snapshot.SnapshotError, match="p: line diff budget"):
        snapshot.added_lines(base, head, moves)
