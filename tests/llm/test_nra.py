import math
import random

import numpy as np

from strata.llm.nra import SortedLists, exact_top_k, no_random_access

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, queries, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted(set(queries)):
        for w in [v for i, v in ok if i == q][:1]:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, [float(np.float32(rng.uniform(-1, 1))) for _ in range(12)]) for k in range(300)]
    rows += [(k, rows[k % 7][1]) for k in range(300, 340)]
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (404, [0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    queries = df.where("vec_id % 20 = 0")
    want = plain(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 5)
    for block_rows, block_queries in ((16_384, 2_048), (40, 3)):
        got = sorted(tuple(r) for r in exact_top_k(df, queries, 5, block_rows=block_rows, block_queries=block_queries).collect())
        assert got == want


def test_reading_stops_early_without_losing_a_row():
    rng = np.random.default_rng(1)
    values = np.floor(rng.normal(0, 32, (4_000, 6))).astype(np.int64)
    values[:50] *= 4  # long vectors stand out
    lists, depths = SortedLists(values), []
    for q in range(40):
        at, scores, depth = no_random_access(lists, values, values[q], np.array([q]), 5)
        exact = values @ values[q]
        exact[q] = -(1 << 60)
        want = np.lexsort((np.arange(4_000), -exact))[:5]
        assert (at[:5] == want).all() and (scores[:5] == exact[want]).all()
        depths.append(depth)
    assert max(depths) < 4_000 and min(depths) <= 1_000


def test_depths_read_are_reported(spark):
    rows = [(k, [float(k == j) + k / 1000 for j in range(3)], 0) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_top_k(df, df.where("vec_id < 3"), 5, depth=True).collect()
    assert all(0 < r.n_read <= 200 for r in got) and len({(r.query_id, r.n_read) for r in got}) == 3


def test_large_components(spark):
    import pytest

    big = [(0, [2.0**20, 1.0], 0), (1, [2.0**21, 3.0], 0), (2, [2.0**21, 4.0], 0)]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>, label int")
    want = [(0, 1, 2, (1 << 57) + 256 * 1024), (0, 2, 1, (1 << 57) + 256 * 768)]
    assert [tuple(r) for r in exact_top_k(df, df.where("vec_id = 0")).collect()] == want
    for huge in (1e12, 1e17):
        bad = spark.createDataFrame([(0, [huge], 0), (1, [huge], 0)], "vec_id bigint, embedding array<double>, label int")
        with pytest.raises(Exception):  # noqa: B017, PT011
            exact_top_k(bad, bad.where("vec_id = 0")).collect()


def test_few_candidates_and_empty(spark):
    one = spark.createDataFrame([(0, [1.0], 0)], SCHEMA)
    assert exact_top_k(one, one).collect() == []
    two = spark.createDataFrame([(0, [1.0], 0), (3, [2.0], 0), (0, [1.0], 0)], SCHEMA)
    assert [tuple(r) for r in exact_top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 3, 256 * 512)]
    none = spark.createDataFrame([], SCHEMA)
    assert exact_top_k(none, none).collect() == [] == exact_top_k(one, none).collect()
