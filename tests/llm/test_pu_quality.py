import zlib

import numpy as np

from strata.llm import pu_quality
from strata.llm.queries import op1_pu_quality


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op1_pu_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in own) >= 0.95 * len(own)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.rdd.map(lambda r: (r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality)).toDF("doc_id bigint, quality int")
    score = lambda x: sorted((r.doc_id, r.score) for r in pu_quality.pu_quality(docs, x).collect())
    assert score(labels) == score(flipped)


def test_prior_and_risk_on_known_data():
    rng = np.random.default_rng(5)
    positive = rng.normal(1, 1, (3_000, 4))
    unlabelled = np.concatenate([rng.normal(1, 1, (2_400, 4)), rng.normal(-2, 1, (600, 4))])
    order = rng.permutation(3_000)
    prior = pu_quality.estimate_prior(positive, unlabelled[order])
    assert abs(prior - 0.8) < 0.08
    net = pu_quality.fit(positive, unlabelled[order], prior)
    truth = np.arange(3_000) < 2_400
    assert ((net.score(unlabelled) >= 0.5) == truth).mean() > 0.97


def test_odd_rows_and_missing_roles(spark, docs):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "\x00é😀"), (3, "\x00é😀"), (4, "w " * 100_000), (5, "plain words.")]
    labels = spark.createDataFrame([(5, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    got = pu_quality.pu_quality(docs(rows), labels).collect()
    assert len(got) == len(rows) and next(r for r in got if r.doc_id is None).held_out
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in pu_quality.pu_quality(docs(rows), none).collect()} == {0.5}
    assert pu_quality.pu_quality(docs([]), labels).collect() == []
    odd = spark.createDataFrame([(1, "a", 0.5, 3)], "doc_id int, text string, score double, id int")
    assert [tuple(r) for r in pu_quality.keep_good(odd, none).collect()] == [(1, "a", 0.5, 3)]
    assert pu_quality.pu_quality(odd, none).columns == ["doc_id", "held_out", "score", "predicted"]


def test_every_word_of_a_long_text_counts():
    share = lambda n: pu_quality.features("lower Upper " * n)[len(pu_quality._CLASSES) + 6]
    assert share(100) == share(5_000) == 0.5


def test_a_repeated_id_is_sampled_once(docs, spark):
    rows = [(1, "one text")] * 300 + [(2, "another."), (4, "good words."), (6, "more good words.")]
    labels = spark.createDataFrame([(4, 1), (6, 1)], "doc_id bigint, quality int")
    free = [i for i in (1, 2, 4, 6) if not held_out(i)]
    positive, unlabelled = pu_quality.training_sample(docs(rows), labels, "doc_id", "text", "quality", 1_000, 1_000)
    assert (len(positive), len(unlabelled)) == (sum(i in (4, 6) for i in free), sum(i in (1, 2) for i in free))
    assert len(positive) and len(unlabelled)
