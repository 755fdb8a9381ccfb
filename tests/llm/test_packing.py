from __future__ import annotations

from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from airspark.llm.packing import cutting_patterns, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string, length int"


def check(rows, got, capacity=2048):
    """Every id of every document in one piece, sequences gapless and within the capacity."""
    coder = Tokenizer.from_file(PATH)
    want = {}
    for doc, text, *_ in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault((doc, len(ids), crc32(np.array(ids, "<u4").tobytes())), []).append(ids)
    left = sorted((str(d), n) for d, n, _ in (k for k, v in want.items() for _ in v))
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sorted((str(d), n) for (d, n), p in pieces.items() for _ in range(sum(x["start"] == 0 for x in p))) == left
    for (doc, n, _), copies in want.items():
        for ids in copies:
            for at in range(0, n, capacity):
                code = crc32(np.array(ids[at : at + capacity], "<u4").tobytes())
                assert any(x["start"] == at and x["ids_crc32"] == code and x["length"] == len(ids[at : at + capacity]) for x in pieces[doc, n])
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


ROWS = [
    (1, "The quick brown fox's tail, 42 times.", "x", 1),
    (2, None, None, None),
    (3, "", "y", 2),
    (4, "word <|endoftext|> and \x01 mark \x1c!\x1c! é É Σσς   x", "z", 3),
    (5, "long\nrun " * 9000, "z", 3),
    (5, "same id", "z", 3),
    (6, "equal", "q", 4),
    (6, "equal", "q", 4),
    (None, "no id \t\t tabs\r\nlines", None, 0),
    (7, "a" * 30_000, None, 0),
]


def test_whole_texts_and_odd_rows(spark):
    got = pack(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    check(ROWS, got)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_many_documents_pack_tightly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "lorem ipsum dolor " * int(rng.integers(1, 400)), None, 0) for i in range(600)]
    got = pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    sequences = check(rows, got)
    tokens = sum(r["length"] for r in got)
    assert tokens / (2048 * len(sequences)) > 0.97


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 64), 20, replace=False))
    demand = rng.integers(1, 200, 20)
    patterns = cutting_patterns(sizes, demand, 64)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all(p @ sizes <= 64 for p, _ in patterns)
    # Two items over half the capacity never share a sequence.
    bound = max(sizes @ demand / 64, demand[sizes > 32].sum())
    assert sum(n for _, n in patterns) <= 1.05 * bound + 2
