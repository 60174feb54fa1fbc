from __future__ import annotations

import random

import pytest


@pytest.fixture
def rng() -> random.Random:
    return random.Random(11)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, key string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty texts, repeated rows, one id with two texts, and columns with clashing names."""
    long = "One long text says the same again and again without a stop or a name in it. " * 400
    rows = [
        (3, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70, 1, "x"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70, 1, "x"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70, 1, "x"),
        (2, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 2, "y"),
        (5, " \n\t ", "en", "b", 4, 2, "y"),
        (None, "A row without an id has a text of its own that nobody else has written so far.", "en", None, 1, None, None),
        (7, "first text under the number seven is about ships and the sea and nothing else at all", "en", "c", 1, 3, None),
        (7, "second text under the number seven is about trains and the land and the hills around", "en", "c", 1, 3, None),
        (8, long, "en", "c", len(long), 3, None),
        (9, "short one", "en", "c", 9, 3, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
