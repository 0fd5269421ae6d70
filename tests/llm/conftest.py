import pytest

WEIRD = [
    (1, "The quick brown fox jumps. " * 30, "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, "one", "de", "a"),
    (5, "two words", "de", "a"),
    (None, "no id here at all", "fr", "c"),
    (7, "The quick brown fox jumps. " * 30, "en", "a"),
    (7, "The quick brown fox jumps. " * 30, "en", "a"),
    (8, "é 漢字 😀 \x0b tabs\tand\nlines\n\nlines\nlines", "en", "b"),
    (9, " ".join(f"w{i}" for i in range(30000)), "en", "a"),
    (10, "x" * 50000, "en", "a"),
]
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns named like the operators' own."""
    rows = [(*r, "x", "y", 1, 2) for r in WEIRD]
    return spark.createDataFrame(rows, DOCS + ", kept string, fp string, n int, row int")
