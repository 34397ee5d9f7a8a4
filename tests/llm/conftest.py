from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "si", "to", "nu") for c in ("", "ly", "n", "st")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    one, two, long = prose(rng, 60), prose(rng, 80), prose(rng, 4000)
    rows = [(1, one, "a"), (2, one, None), (3, two, "b"), (3, two, "b"), (4, None, "b"), (5, "", None), (6, long, "a"),
            (None, two, "c"), (None, None, None), (7, "x", "c"), (8, "é" * 500, "a"), (9, " \t\n ", "a"),
            (10, one + " tail", "b"), (3, "another text under id three", "b")]
    frame = spark.createDataFrame([(*r, 1, 2.0, "k", 0) for r in rows],
                                  "doc_id long, text string, source string, size int, score double, `key` string, node int")
    return frame


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size int, score double, `key` string, node int")
