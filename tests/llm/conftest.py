import pytest

ODD = [
    (3, "one two three four five six seven", "en", "a", 33),
    (None, "a row without an id but with words", "en", "b", 34),
    (1, None, None, None, None),
    (2, "", "de", "a", 0),
    (5, "one two three four five six seven", "en", "a", 33),
    (5, "one two three four five six seven", "en", "a", 33),
    (4, "  spaced  out \n\n text\twith tabs ", "fr", "b", 31),
    (6, "é" * 70 + " <|endoftext|> it's 'll 12345   \x1c end", "xx", "c", 99),
    (7, "word " * 3000, "en", None, 15000),
    (8, "x", "en", "c", 1),
]
COLS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, clashing extra columns."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ODD, COLS).repartition(3)
    return d.withColumns({c: F.lit(9) for c in ("size", "score", "row", "key", "v", "t", "c", "k", "target", "class", "copies", "a", "b", "start", "words")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLS)
