import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, name string, manifest_id string, page_number int, text string"


@pytest.fixture(scope="session")
def pages(spark):
    """Page texts of one volume with the given texts; doc_id counts from 1."""

    def make(texts, ids=None):
        ids = range(1, len(texts) + 1) if ids is None else ids
        rows = [Row(i, f"R0001203_{n:05d}.jpg", "R0001203", n, t) for n, (i, t) in enumerate(zip(ids, texts), 1)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def with_clashes():
    """The same pages with further columns named like results and inner columns."""

    def add(df, *names):
        from pyspark.sql import functions as F

        kept = ["kept", "print", "keep_id", "score", "shard", "start", "length", "key", "__key_0", "word", "node"]
        return df.withColumns({n: F.lit("x") for n in [*kept, *names]})

    return add


HARD = [None, "", " ", "\n\t", "a", "a a a", "¡Ñandú! 🙂", "word " * 30_000, "x" * 100_000, None, "", "a"]


@pytest.fixture(scope="session")
def hard():
    """Nulls, empty, blank and very long texts, and repeated ones."""
    return HARD
