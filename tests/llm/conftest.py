"""A small corpus with the cases that every operator must stand."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kid string, th string, number int, place int"


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    prose = [" ".join(rng.choices(words, k=rng.randint(30, 90))) for _ in range(12)]
    passage = " ".join(rng.choices(words, k=50))
    return [
        None, "", "   \n\t ", "x", "a b", "A  b\n\nC\u00a0d", "Ärger ß – naïve 日本語 \U0001f600", "same words " * 40, "z" * 9000, "ab" * 700 + " " + "1" * 900,
        *prose, prose[0], prose[0], prose[1] + " tail", "head " + prose[1], f"one {passage} two", f"three {passage} four {passage}", "line one\nline one\nLine 7 of 9\n",
        *[f"doc {i} says\nAll rights reserved {i}\nbody {' '.join(rng.choices(words, k=20))}" for i in range(12)], "\x1c\x85\u2028 odd \x0b spaces", "<|endoftext|> 's 're don't", "\\### </turn>",
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The texts with doc_ids, one null, some repeated rows, and columns whose names operators use inside."""
    rows = [(None if i == 3 else i, t, "en" if i % 5 else None, None, None if t is None else len(t), "k", None, 1, 2) for i, t in enumerate(odd_texts)]
    rows += [rows[12], rows[12], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
