import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size string, shard string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, very long and repeated texts, ties, repeated rows, and columns whose names clash with ours."""
    base = "the quick brown fox jumps over the lazy dog and runs to the river of gold " * 3
    rows = [
        (1, base, "en", "a", 1, 0.1, "x", "y", "z"),
        (2, base, "en", "a", 1, 0.1, "x", "y", "z"),
        (2, base, "en", "a", 1, 0.1, "x", "y", "z"),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 0.2, "x", "y", "z"),
        (5, "   \n\t ", "en", "b", 0, 0.2, "x", "y", "z"),
        (None, "a text without an id, of some words in the language", "en", None, 3, 0.3, "x", "y", "z"),
        (None, None, "en", "c", 3, 0.3, "x", "y", "z"),
        (6, "one", "en", "c", 3, 0.3, "x", "y", "z"),
        (7, "two words", "en", "c", 3, 0.3, "x", "y", "z"),
        (8, "É😀 ünï " * 40 + "password=abcdef123", "fr", "d", 3, 0.3, "x", "y", "z"),
        (9, " ".join(f"w{i * 7919 % 5003} of the v{i % 97}" for i in range(15000)), "en", "a", 3, 0.3, "x", "y", "z"),
        (10, "x" * 70000, "en", "a", 3, 0.3, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    from millrace.llm import common

    return common.documents(spark, sf)
