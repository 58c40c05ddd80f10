import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    def make(rows, sources=None):
        return spark.createDataFrame(
            [(i, t, "en", sources[k] if sources else f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA
        )

    return make
