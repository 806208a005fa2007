import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, long), (6, "a b c d e f"), (6, "a b c d e f"), (None, "no id at all here"), (8, "x" * 50_000), (9, "naïve café 日本語 ▁ 😀 end.\n\nnext line")]
    return spark.createDataFrame([(i, t, None, "s", 0, -1.0, "mine", 7) for i, t in rows], DOCS + ", score double, fingerprint string, n_words int").coalesce(2)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
