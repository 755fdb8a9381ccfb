"""Merkle manifests against a plain recursive tree."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import groupby

import pytest

from airspark.llm import manifest
from airspark.llm.manifest import merkle_manifest, tamper_check

SCHEMA = "text string, doc_id long, source string, _i string, n_chars long, lang string, leaf string, digest string, _s int"
LOWER = {i: i + 32 for i in range(65, 91)}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The top of some nodes and the steps (left, right) from each node to it."""
    steps = [[] for _ in nodes]
    over = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for j in run:
                for i in over[j]:
                    steps[i].append(("".join(nodes[k] for k in run if k < j), "".join(nodes[k] for k in run if k > j)))
        over = [[i for j in run for i in over[j]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], steps


def expected(rows, tampered=lambda doc_id: doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    order = lambda r: ((r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0), leaf_of(*r))
    sources = [list(g) for _, g in groupby(sorted(rows, key=order), key=lambda r: r[1])]
    trees = [tree([leaf_of(*r) for r in g]) for g in sources]
    root, outer = tree([t for t, _ in trees])
    out = []
    for g, (top, steps), beyond in zip(sources, trees, outer):
        for r, own in zip(g, steps):
            path = own + beyond
            node = leaf_of(*r[:4], r[4].translate(LOWER)) if tampered(r[0]) and r[4] is not None else leaf_of(*r)
            for left, right in path:
                node = h(left + node + right)
            out.append((r[0], leaf_of(*r), top, root, h("".join(a + b for a, b in path)), node, node == root))
    return out


def made(spark, rows):
    return spark.createDataFrame([(r[4], r[0], r[1], "x", r[3], r[2], "y", "z", 1) for r in rows], SCHEMA)


def check(spark, rows):
    got = tamper_check(made(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def generated(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Plain Text É", "lower", "AB" * rng.randrange(40)])
            rows.append((rng.randrange(10 * n), source, rng.choice(["en", None, ""]), rng.choice([None, 0, -5, 77]), text))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {None: 17, "": 1, "b": 257}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    check(spark, generated(str(sizes), sizes))


def test_superblocks_and_levels_above(spark, monkeypatch):
    # Blocks of 16 leaves: two levels above the blocks of the larger source.
    monkeypatch.setattr(manifest, "SUPER", 1)
    monkeypatch.setattr(manifest.local_levels, "__defaults__", (16, 1))
    check(spark, generated(8, {"large": 700, "é": 30, "É": 16, None: 3}))


def test_repeated_rows_and_ids(spark):
    row = (5, "a", "en", 3, "Abc")
    check(spark, [row] * 20 + [(5, "a", "en", 3, "Other")] * 2 + [(None, "a", None, None, None), (None, None, None, None, "ABC")])


def test_a_changed_row_is_found(spark):
    rows = generated(2, {"a": 100, "b": 5})
    docs = made(spark, [(i, *r[1:]) for i, r in enumerate(rows)])
    clean = merkle_manifest(docs)
    assert clean.where("not verified").isEmpty()
    from pyspark.sql import functions as F

    bad = merkle_manifest(docs, F.col("doc_id") == 7, {"n_chars": F.lit(-1)})
    assert [r.doc_id for r in bad.where("not verified").collect()] == [7]


def test_empty_table(spark):
    assert tamper_check(made(spark, [])).collect() == []
