import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long_text = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
    fine = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing above."
    rows = [
        (1, fine, "en", "a", 5, "x", 1),
        (2, fine, "en", "a", 5, "x", 1),
        (2, fine, "en", "a", 5, "x", 1),
        (3, "", "en", "a", 0, None, None),
        (4, None, None, None, None, None, None),
        (None, fine + " More words here.", "en", "b", 7, "y", 2),
        (5, long_text, "en", "b", 7, "y", 2),
        (6, " \t\n\r\x0b\x0c ", "en", "b", 7, "y", 2),
        (7, "Ünïcode ✓ 日本 👩‍💻 text\u00a0glued\u2003wide", "xx", "c", 7, "y", 2),
        (8, fine.upper(), "en", "a", 9, "z", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
