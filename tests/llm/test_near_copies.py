import random

import corpus_pipeline
from strata.llm import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values())


def corpus():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, " \n"), (2, "one"), (3, "ONE"), (4, "one two"), (5, "x" * 50_000)]
    phrase = " ".join(f"common{k}" for k in range(40))
    for k in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 300))]
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words) + (f" {phrase}" if k % 2 else "")))
    chain = [f"c{k}" for k in range(200)]  # neighbours are similar, the ends are not
    for k in range(12):
        rows.append((len(rows), " ".join(chain[10 * k : 10 * k + 100])))
        rows.append((len(rows), " ".join(chain[10 * k + 5 : 10 * k + 105])))
    return rows


def test_stage_links_all_pairs_that_reach_the_similarity(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_recall_at_the_similarity_and_no_false_link(spark):
    rng = random.Random(4)
    rows = []
    for k in range(0, 800, 2):  # pairs as far apart as may be: Jaccard 0.80 to 0.82
        words = [f"w{rng.randrange(3_000)}" for _ in range(300)]
        other, at = list(words), rng.sample(range(0, 300, 6), 6)
        for a in at:
            other[a] = f"x{rng.randrange(10**6)}"
        one, two = plain_set(" ".join(words)), plain_set(" ".join(other))
        if 0.8 <= len(one & two) / len(one | two) < 0.83:
            rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
    assert len(rows) > 400
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.id: r.component_id for r in near_copies.near_copy_groups(df).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert sum(got[i] != i for i in got) >= 0.9 * len(rows) / 2


def test_a_large_group_makes_no_square_of_pairs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:k % 390] + [f"y{rng.randrange(10**9)}"] + words[k % 390 + 1 :])) for k in range(600)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert [r.doc_id for r in near_copies.drop_near_copies(df).collect()] == [0]


def test_two_changed_words_are_one_document(spark):
    words = [f"word{k}" for k in range(266)]
    other = [w + "x" if k in (60, 180) else w for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(other), "en", "s", 0)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()] == [1]


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e"), (5, "f g h i j"), (5, "A b c d e"), (None, "f g h i j"), (None, "k l m n o")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.text.lower()) for r in near_copies.drop_near_copies(df).collect())
    assert got == [("5", "a b c d e"), ("5", "f g h i j"), ("None", "k l m n o")]


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == plain_kept(rows)
