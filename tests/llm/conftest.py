import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, words string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, one long text, and columns named like results."""
    long = " ".join(f"word{i % 977} of the long text" for i in range(20_000))
    rows = [
        (1, None, "en", "a", None, "x", "y", "z"),
        (2, "", None, None, 0, None, None, None),
        (3, " \n\t ", "en", "a", 4, None, None, None),
        (4, "the same row twice", "en", "b", 18, None, None, None),
        (4, "the same row twice", "en", "b", 18, None, None, None),
        (None, "a row without an id", "fr", None, 19, None, None, None),
        (5, long, "en", "a", len(long), None, None, None),
        (6, "日本語 emoji 😀 café", None, "b", 16, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
