from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: names that the operators use inside, as columns of the input
CLASHING = ["chunk", "key", "size", "shard", "f0", "n", "a", "b", "root", "toxicity", "spans", "hashes", "place"]


@pytest.fixture(scope="session")
def make(spark):
    """make(rows, extra): a table of documents from (doc_id, text), with clashing columns if ``extra``."""

    def build(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows], SCHEMA)
        if extra:
            df = df.selectExpr("*", *(f"'x' as {c}" for c in CLASHING))
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words): made-up text."""

    def build(seed, words):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(words))

    return build


@pytest.fixture(scope="session")
def odd(prose):
    """Nulls, empty and very long texts, ties, repeated rows, characters of several bytes."""
    long = prose(1, 30_000)
    return [(0, "é" * 60 + " " + prose(2, 40)), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, prose(3, 80)), (5, prose(3, 80)), (6, prose(3, 80)), (7, "ü" + "é" * 60), (None, prose(3, 80)), (None, None), (8, "word"), (9, long + " end")]
