import hashlib

from strata.llm.extendible import extendible_shards


def plain(rows, limit):
    sizes = [(i, len((t or "").encode()), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)) for i, t in rows]
    out = []
    for i, n, h in sizes:
        for d in range(61):
            own = [m for _, m, g in sizes if g >> (60 - d) == h >> (60 - d)]
            if sum(own) <= limit or len(own) == 1:
                out.append((i, n, bin(h >> (60 - d))[2:].zfill(d) if d else "", d, None, sum(own), len(own)))
                break
    return sorted(out, key=str)


def test_shards_match_brute_force(docs):
    rows = [(k, "x" * (k * 7 % 90)) for k in range(150)] + [(None, "y" * 40), (200, None), (201, "z" * 5000)]
    for limit in (100, 700, 10_000, 1 << 20):
        got = sorted((tuple(r) for r in extendible_shards(docs(rows), limit=limit).collect()), key=str)
        assert got == plain(rows, limit)
        assert all(r[5] <= limit or r[6] == 1 for r in got)


def test_rows_of_a_hot_id_split_by_row(docs):
    rows = [(5, "a" * 50)] * 60 + [(k, "b" * 50) for k in range(100, 160)]
    got = extendible_shards(docs(rows), limit=200).collect()
    assert len(got) == 120 and all(r.shard_bytes <= 200 for r in got)
    assert {r.doc_id for r in got if r.overflow is not None} == {5}
    totals = {}
    for r in got:
        totals.setdefault((r.prefix, r.overflow), []).append(r)
    assert all(sum(x.n_bytes for x in v) == v[0].shard_bytes and len(v) == v[0].shard_rows for v in totals.values())


def test_empty_and_clashing_columns(spark, docs):
    assert extendible_shards(docs([])).collect() == []
    odd = spark.createDataFrame([(1, "ab", 3, 4)], "doc_id int, text string, `group` int, h int")
    assert [tuple(r) for r in extendible_shards(odd).collect()] == [(1, 2, "", 0, None, 2, 1)]
