"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

LONG = "word " * 30_000 + "end"

TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG),
    (7, "One two three four five six seven eight nine ten eleven twelve thirteen"),
    (7, "One two three four five six seven eight nine ten eleven twelve thirteen"),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    (None, None), (8, "É́tude 🙂 ok\r\nx\u0085y <|endoftext|>z"), (9, "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents as above; the extra columns are called like what operators add."""
    rows = [(i, t, "en", None, -1, "mine", 7, [1]) for i, t in TEXTS]
    names = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, id long, _lines array<int>"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, 0), (8, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [
            (1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (3, ""),
            (4, "A"), (None, "one two three four five six seven eight nine ten eleven twelve thirteen"), (4, "a"),
        ],
        "item_id long, text string",
    )
