import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank texts, repeated rows, an id with two texts, and columns named like internals."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog"), (2, "The quick  brown fox jumps over the lazy dog"), (2, "The quick  brown fox jumps over the lazy dog"), (3, "the quick brown fox jumps over the lazy cat"),
        (None, "the quick brown fox jumps over the lazy dog"), (4, None), (None, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, "two words"), (10, "first text of ten here"), (10, "another text of ten here"), (11, "ünïcödé ñandú 你好 " * 3),
    ]
    schema = "doc_id long, text string, g string, n int, ids string, bucket string, block string, key string, spans string, toxic string, toxic_score string, n_chars long"
    return spark.createDataFrame([(i, t, "a", 1, "b", "c", "d", "e", "f", "h", "i", len(t or "")) for i, t in rows], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n int, spans string")
