import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    words = " ".join(f"word{k % 97} other{k % 89}" for k in range(30_000))
    rows = [(1, "a short text of just seven words", "en", "s", 1), (1, "a short text of just seven words", "en", "s", 1),
            (2, "", "en", "s", 0), (3, None, None, None, None), (None, "no id but a text", "en", "s", 1), (None, None, None, None, None),
            (4, words, "en", "s", 9), (4, "one id with another text", "en", "t", 9), (5, " \n\t ", "en", "s", 0), (6, "x" * 70_000, "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Columns with the names that operators use inside."""
    out = odd_docs
    for name in ("slot", "shard", "text_key", "head", "_row", "host", "score", "key", "spans", "_text", "block", "window", "at", "tree", "prefix", "_id"):
        out = out.withColumn(name, F.lit("mine"))
    return out
