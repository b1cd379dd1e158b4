import pytest

DOC = "doc_id long, text string"


@pytest.fixture
def frame(spark):
    """Documents from (id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        schema = DOC + ", lang string, source string, n_chars long, n int, key string, digest string, spans string"
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "k", "d", "x") for i, t in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, repeated rows, shared ids, very long texts and words."""
    return [
        (1, None), (2, ""), (3, "  \n "), (4, "One plain text of words."), (4, "One plain text of words."), (5, "One plain text of words."), (6, "Other text under a shared id"),
        (6, "and its neighbour"), (None, "A row without an id."), (None, None), (7, "x" * 200_000), (8, "long " * 30_000), (9, "Été 日本語 \U0001f600 <|endoftext|> \u0000 tab\there"),
    ]
