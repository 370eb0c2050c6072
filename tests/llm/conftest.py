import pytest

from tidemark.llm.shared import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, DATA, "documents").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


#: Nulls in every column, empty and long texts, repeated rows, and columns that clash with the operators' own.
ODD = [
    (1, "plain words of a short text", "en", "a", 1, 0.5), (1, "plain words of a short text", "en", "a", 1, 0.5), (2, None, None, None, None, None), (3, "", "en", "b", 0, 0.1), (None, "no id here at all", None, None, 1, 1.0),
    (4, " \t\n ", "xx", "a", 3, 2.0), (5, "word " * 60_000, "en", "b", 300_000, 0.0), (2**60 + 1, "a very large id with a text", "de", "c", 9, 0.0),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    for clash in ("quality", "kept", "mix_source", "mix_pass", "component_id", "row", "part"):
        df = df.selectExpr("*", f"'x' AS {clash}")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def large_ids(spark):
    """Ids that a float cannot hold, beside a null, in one partition; texts of 80 words each."""
    rows = [(None, 0), (2**60 + 1, 1), (2**60 + 2, 2), (None, 3)]
    text = lambda k: " ".join(f"w{(k + 1) * i * i % 997}x{i}" for i in range(80))
    return spark.createDataFrame([(i, text(k), "en", "a", 9) for i, k in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
