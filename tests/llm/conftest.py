import pytest


#: Nulls, empty and long texts, ties, repeated rows and ids, and columns that clash with the operators' own.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs away from the old grey cat", "en", "s", 1),
    (2, "the quick brown fox jumps over the lazy dog and then it runs away from the old grey cat", "en", "s", 2),
    (3, "", None, None, None),
    (4, None, None, None, None),
    (5, "word", "de", "s", 4),
    (5, "word", "de", "s", 4),
    (6, "é ß 日本 😀 'quoted' idiot\tx\ny  z ", "fr", "t", 9),
    (7, "lorem ipsum dolor " * 3000, "la", "t", 7),
    (None, "no id but text, token = abcdef123456", None, None, 3),
    (None, None, None, None, None),
    (8, "Released under the MIT License.\nThe quick brown fox jumps over the lazy dog and then it runs away", "en", "s", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, named like those that the operators make."""
    out = docs
    for name in ("score", "fp", "found", "spans", "blob", "row", "shard", "key", "n_words", "items", "ids", "hash", "place", "bucket", "decoded"):
        out = out.selectExpr("*", f"1 as {name}")
    return out
