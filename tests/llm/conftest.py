from __future__ import annotations

import random

import pytest

#: Texts that every operator has to take: null, empty, white space, very long, repeated, marks, other scripts.
LONG = "word%d " * 4000 % tuple(range(4000))
AWKWARD = [None, "", " ", "\n\t", "a", "a b", "Same text here", "Same text here", "Same  text\nhere", LONG, LONG, "é ß 漢字 😀 \x00 end", "<|im_end|>", "▁▁ x", "A" * 5000]


@pytest.fixture
def awkward(spark):
    """Rows with nulls in any column, a repeated row, and columns whose names clash with what operators add."""
    rows = [(i, t, "keep", "rule", 1.0) for i, t in enumerate(AWKWARD)] + [(None, "no id", None, None, None), (3, "\n\t", "keep", "rule", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, verdict string, score double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture
def rng():
    return random.Random(11)


def words(r: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))
