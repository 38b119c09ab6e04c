"""Rows with the awkward cases every operator must take."""

import pytest

LONG = " ".join(f"word{i % 9000}" for i in range(60_000))
TEXTS = [
    (1, "The Quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again ok."),
    (2, "the quick BROWN fox jumps over the lazy dog and runs away from the big bad wolf today again ok."),
    (3, ""),
    (4, None),
    (None, "a text without an id"),
    (5, "One line\none line\n\n one line\nlast # * $"),
    (5, "One line\none line\n\n one line\nlast # * $"),
    (6, LONG),
    (7, "  spaces  first\tand odd ones \x1c ▁ \U0001f600 é "),
    (8, " ".join(["again"] * 300)),
    (9, "\n"),
    (10, "Released under the MIT License. All rights reserved. CC BY-NC 4.0, cc by"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use."""
    rows = [(i, t, "x", None, 7, "mine") for i, t in TEXTS]
    schema = "doc_id long, text string, kept string, score double, length int, row string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def copies(spark):
    """A third of all rows are one text; each other text has one or two rows."""
    rows = [(i, "Hot text of many copies" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
