import random
import re
from itertools import combinations

from strata.llm.length_buckets import optimal_bounds, pack_by_length
from strata.llm.queries import op2_length_buckets


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in histogram.items())


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(300):
        lengths = rng.sample(range(0, 40), rng.randint(1, 9))
        histogram = {x: rng.randint(1, 20) for x in lengths}
        k = rng.randint(1, 5)
        got = optimal_bounds(histogram, k)
        assert len(got) <= k and got == sorted(got)
        ordered = sorted(lengths)
        best = min(padding(histogram, [*c, ordered[-1]]) for r in range(min(k, len(ordered))) for c in combinations(ordered[:-1], r))
        assert padding(histogram, got) == best
    assert optimal_bounds({}, 4) == []


def verify(rows, lengths, batch_tokens):
    slices = [(i, min(batch_tokens, n - i * batch_tokens)) for n in lengths for i in range(max(1, -(-n // batch_tokens)))]
    assert sorted((r.slice, r.n_tokens) for r in rows) == sorted(slices)
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    short = {}
    for (bucket, _), own in batches.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        bound = own[0].bucket_len
        assert len(own) * bound <= batch_tokens
        capacity = batch_tokens // max(bound, 1)
        short[bucket] = short.get(bucket, 0) + (len(own) < capacity)
    assert all(n <= 1 for n in short.values())


def test_batches_fit_and_are_full(spark, docs):
    rng = random.Random(4)
    rows = [(k, " ".join("w" * rng.choice([1, 1, 3, 20, 90]))) for k in range(200)]
    rows += [(None, None), (None, None), (7, ""), (7, ""), (8, "x " * 5000)]
    got = pack_by_length(docs(rows), buckets=3, batch_tokens=256, chunks=8).collect()
    verify(got, [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows], 256)
    assert sum(r.doc_id is None for r in got) == 2
    assert len({r.bucket for r in got if r.n_tokens <= 256}) <= 3


def test_empty_and_clashing_columns(spark, docs):
    assert pack_by_length(docs([])).collect() == []
    odd = spark.createDataFrame([(1, "a b", 9, 9, 9)], "doc_id int, text string, bucket int, row int, n_tokens int")
    assert [tuple(r) for r in pack_by_length(odd).collect()] == [(1, 0, 2, 0, 2, 0, 0, 0)]


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    verify(op2_length_buckets(spark, sf).collect(), [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts], 16_384)
