import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long"

ODD_TEXTS = [
    None, "", " ", "\n", "\n\n", "a", "word " * 30, "x" * 50_000, "one two three\tfour\u00a0five",
    "Línea única número uno\nshared line of some length\n\nshared line of some length",
    "  SHARED line of some length \nother", "b\\c <d> # e | $5 100% *", "日本語 テキスト 🎉",
    "the quick brown fox jumps over it " * 6, "the quick brown fox jumps over it " * 6,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names used inside."""
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 0, 9, 9) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[13], (None, "null id", None, None, None, None, None), (None, "null id", None, None, 1, 1, 1)]
    return clashing(spark.createDataFrame(rows, DOCS))


def clashing(docs):
    """With columns of names that the operators, or Spark's files, use themselves."""
    names = ("_metadata", "__path", "__row", "__copies", "path", "row", "caller", "verdict", "copies", "body", "key")
    return docs.withColumns({name: F.lit(f"own {name}") for name in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], DOCS))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(15)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
