import corpus_pipeline


def test_short_pages_lose_their_boilerplate(spark, docs):
    menu = "home, news, contact and all of the other pages of this site"
    rows = [(k, f"{menu}\nown {k}") for k in range(10)] + [(10, f"{menu}\n \n{menu}"), (11, None)]
    sources = [f"s{k}" for k in range(10)] + ["s0", "s1"]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(rows, sources), "").collect()}
    assert got == {**{k: f"own {k}" for k in range(10)}, 10: rows[10][1], 11: None}
