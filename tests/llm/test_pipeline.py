import corpus_pipeline
from strata.llm import length_buckets, line_spread, near_copies, secrets


def test_stages_and_whole_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "secret scans", "packing"]
    good = corpus_pipeline.quality(spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.9 * len(labels)  # some 60 positives train it here
    rows = good.collect()
    copy = spark.createDataFrame(rows, docs.schema)
    by_hand = length_buckets.pack_by_length(secrets.redact_secrets(near_copies.drop_near_copies(line_spread.remove_spread_lines(copy, max_loss=None))))
    run = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in run.collect()) == sorted((r.doc_id, r.n_tokens) for r in by_hand.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_odd_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (2, "x" * 50_000, "en", "s", 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.collect()
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.collect() == []
