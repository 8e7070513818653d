import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
        (3, None, None, None, None),
        (None, "nothing to see here", None, "b", 19),
        (None, None, "fr", "b", None),
        (4, "", "en", "c", 0),
        (5, "   \n\t ", "de", None, 6),
        (6, LONG, "en", "a", len(LONG)),
        (7, "12345 !!! ???", "en", "c", 13),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
