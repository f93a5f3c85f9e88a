import pytest

#: Rows that every operator must take: nulls, empty and long texts, ties, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 1), (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 1), (2, None, None, None, None), (None, "null id text here", "en", None, 3),
    (4, "", "en", "b", 0), (5, " \n\t ", None, "b", 4), (6, "wörd " * 20_000, "de", "b", 5), (7, "The Quick brown fox jumps over the lazy dog " * 3, "en", "a", 1), (8, "x", "en", "c", 1), (9, "token=abcdefghijkl", "fr", "c", 1), (None, None, None, None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns by the names that operators use themselves."""
    names = ["row", "kept", "score", "shard", "slot", "key", "__id", "h", "s", "n_words", "a.b"]
    return spark.createDataFrame([(i, f"some words of text number {i} " * 15, "en", "s1", i, *range(len(names))) for i in range(6)], SCHEMA + "".join(f", `{n}` bigint" for n in names))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
