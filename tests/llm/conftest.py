from __future__ import annotations

import random

import pytest

#: Columns of documents and others whose names the operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, token string, root string, label string, removed string, score string, unit string, _row string"


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents with extra columns from rows of doc_id, text and, if given, lang."""

    def make(rows):
        return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else "en", *[None] * 9) for r in rows], CLASHING)

    return make


@pytest.fixture(scope="session")
def prose():
    """Words of invented prose by seed."""

    def make(seed, n, size=4000):
        rng = random.Random(seed)
        return [f"w{rng.randrange(size)}" for _ in range(n)]

    return make
