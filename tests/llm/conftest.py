import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, words array<string>, fp string, n_tokens int, `__at` int"


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with clashing names."""
    long = "the river of the town and a hill in the wood " * 20_000
    extra = (None, ["x"], "f", 1, 0)
    rows = [
        (1, None, None, None, None, *extra),
        (2, "", "en", "a", 0, *extra),
        (3, " \t\n", None, "a", 3, *extra),
        (4, long, "en", "a", len(long), *extra),
        (5, "one", "en", None, 3, *extra),
        (6, "one", "en", None, 3, *extra),
        (6, "one", "en", None, 3, *extra),
        (7, "İstanbul \U0001f600 ΣΣ é", "tr", "b", 15, *extra),
        (None, "no id here", "en", "b", 10, *extra),
        (None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
