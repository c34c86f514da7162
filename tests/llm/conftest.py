import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, langs=None, ids=None):
        ids = ids if ids is not None else range(len(texts))
        langs = langs or ["en"] * len(texts)
        return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in zip(ids, texts, langs, strict=True)], DOCS)

    return make


@pytest.fixture
def odd(docs, spark):
    """Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns that clash."""
    from pyspark.sql import functions as F

    long = "word " * 40_000
    df = docs([None, "", " \n\t ", "one", "the same text of words here", "the same text of words here", long, "ünïcode \U0001f600 line\nline two"], ids=[1, 2, 3, 4, 5, 5, 6, None])
    clash = ["rank", "part", "d", "row_key", "host", "unit", "n", "length", "_key", "kept", "lang_pred", "score", "doc_key", "s", "line"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture
def empty(docs):
    return docs(["x"]).limit(0)


