import random

from strata.llm import simhash
from strata.llm.queries import op4_simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_fingerprint(text, width=4):
    import re

    import xxhash

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, distance=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", " kappa"]
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "a b c d"), (7, None)]
    for k in range(8, 60):
        rows.append((k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))))
    for k in range(60, 90):
        words = rows[rng.randint(20, 50)][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(90, rows[30][1]), (90, rows[30][1]), (91, "x" * 300_000), (None, rows[31][1])]
    return rows


def test_ball_and_radii_cover_every_distance():
    rng = random.Random(1)
    for parts, distance in ((1, 2), (2, 4), (3, 4), (4, 4), (5, 3)):
        for _ in range(300):
            flips = rng.sample(range(64), rng.randint(0, distance))
            spans = simhash.segments(parts)
            per = [sum(low <= f < low + size for f in flips) for low, size in spans]
            assert any(p <= r for p, r in zip(per, simhash.radii(distance, parts), strict=True))
    assert len(simhash.ball(21, 1)) == 22 and len(set(simhash.ball(10, 2))) == 1 + 10 + 45


def test_fingerprints_match_the_definition():
    for _, text in corpus():
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_groups_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = simhash.simhash_groups(df).collect()
    assert sorted(((r.id, f"{r.fp % 2**64:016x}", r.component_id) for r in got), key=str) == plain_groups(rows)


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = set(base)
    for b in base:
        for _ in range(6):
            values.add(b ^ sum(1 << f for f in rng.sample(range(64), rng.randint(1, 6))))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 4}
    for parts in (2, 3, 4):
        assert {(r.a, r.b) for r in simhash.hamming_links(df, 4, parts).collect()} == want


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    components = {(g[2], g[0] == g[2]) for g in plain_groups(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in components if c is not None})
    other = spark.createDataFrame([(5, "a b c d e", "x"), (5, "f g h i j", "y"), (5, "a b c d e", "z")], "doc_id int, text string, component_id string")
    assert sorted(r.text for r in simhash.drop_near_duplicates(other).collect()) == ["a b c d e", "f g h i j"]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(df).collect() == []
    assert simhash.drop_near_duplicates(df).collect() == []


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op4_simhash(spark, sf).collect()), key=str)
    assert got == plain_groups(rows)
