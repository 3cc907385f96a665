import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) with columns whose names clash with those that operators add."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


ODD = [None, "", "\n", " \t ", "A b c", "A b c", "a  B\tc", "x" * 50_000, "word " * 20_000, "Éa ñ <|endoftext|> 日本語 🙂"]


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, repeated and very long texts; null and repeated ids."""
    return [(i if i != 7 else None, t) for i, t in enumerate(ODD)] + [(4, "A b c"), (4, "another")]
