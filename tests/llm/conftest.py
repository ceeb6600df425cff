from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g int, b string, x string, key string, cls string, label string, size long, shards string, first long, m long"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, extra columns with clashing names."""
    words = [f"w{i % 977}" for i in range(60_000)]
    long = " ".join(words)
    more = (1, "b", "x", "k", "c", "l", 5, "s", 9, 3)
    rows = [
        (None, None, None, None, None, *[None] * 10), (1, "", "en", "a", 0, *more), (2, " \n\t ", "en", "a", 4, *more), (3, long, "en", "b", len(long), *more), (4, long, "de", None, None, *more),
        (5, "Hello hello world", None, "b", 17, *more), (5, "Hello hello world", None, "b", 17, *more), (6, "one two three four five six seven eight", "en", "c", 39, *more),
        (7, "One two three four five six seven EIGHT", "en", "c", 39, *more), (None, "one two three four five six seven eight", "en", "", 39, *more), (8, "é ü \u00a0 <|endoftext|> 's", "fr", "c", 20, *more),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
