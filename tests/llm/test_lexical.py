"""Ranked search over strata against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from airspark.llm import lexical
from airspark.llm.lexical import Best, Items, Piece, impact, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t, *_ in docs]
    n_docs, length = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        own = set(terms(text))
        scores = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((s, d))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, d, s) for r, (s, d) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def corpus():
    rng = random.Random(6)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 300)}"
    docs = [(i * 3 % 1000, " ".join(word() for _ in range(rng.choice([1, 5, 40, 40, 40, 200])))) for i in range(300)]
    docs += [(2000, None), (2001, ""), (2002, "?!"), (None, "w1 w2 w3"), (None, "W1-w2_w3"), (5, "w7 w7"), (5, "w7 w7"), (2003, "É é w1\x85w2"), (2004, "w3 " * 3000)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(9)]
    items += [(20, None), (21, ""), (22, "unheard"), (23, "W3, w3; É"), (23, "another w9"), (23, "another w9"), (None, "w1")]
    return docs, items


def made(spark, items):
    return spark.createDataFrame([(t, "x", i) for i, t in items], "text string, doc_id string, item_id long")


@pytest.mark.parametrize("postings, cells, chars", [(lexical.PIECE_POSTINGS, lexical.CELLS, lexical.BLOCK_CHARS), (300, 64, 100)])
def test_rankings_equal_scoring_everything(spark, clashing, corpus, monkeypatch, postings, cells, chars):
    docs, items = corpus
    monkeypatch.setattr(lexical, "PIECE_POSTINGS", postings)
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", chars)
    for k in (7, 1000):
        got = rank_documents(clashing(docs), made(spark, items), k)
        assert sorted(map(tuple, got.collect()), key=str) == expected(docs, [i for i in items if i[1] is not None], k)


def test_strata_below_the_worst_score_are_not_visited():
    items = Items(["a b"])
    # Documents of three normalisers; terms 0 and 1 of the vocabulary.
    m = np.array([50, 50, 100, 900, 900])
    piece = Piece(np.arange(5), m, np.arange(6), np.array([0, 1, 0, 0, 1], np.int32), np.array([1, 1, 3, 2, 1], np.int32), np.array([10, 10]))
    gain = lambda tf, m: 10 * int(impact(np.int64(tf), np.int64(m)))
    want = [gain(1, 50) * 2, gain(3, 100), gain(2, 900) + gain(1, 900)]
    assert piece.bounds(items).tolist() == [want]
    best, seen = Best(np.array([0]), 1), []
    for wanted in lexical._visits(piece.bounds(items), best):
        seen.append(np.flatnonzero(wanted[0]).tolist())
        for first, cells in piece.scores(items, wanted):
            best.add(first, cells, piece.doc_ids)
    # The second stratum holds a better document than the first; the third cannot.
    assert seen == [[0], [1]] and best.doc.tolist() == [2] and best.least.tolist() == [gain(3, 100)]


def test_empty_tables(spark, clashing, corpus):
    docs, items = corpus
    assert rank_documents(clashing([]), made(spark, items)).collect() == []
    assert rank_documents(clashing(docs), made(spark, [])).collect() == []
    assert rank_documents(clashing([(1, None), (2, "..")]), made(spark, items)).collect() == []
