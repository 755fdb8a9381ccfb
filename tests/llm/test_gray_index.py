"""SimHash components from the Gray-order index against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from airspark.llm import grayindex
from airspark.llm.grayindex import GrayIndex, gray_rank, links, near_groups, simhash
from airspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    """Smallest reachable entry per node, all pairs compared."""
    root = list(range(len(nodes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(nodes))]


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    tops = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for (doc, _), t in zip(rows, tops):
        if doc is not None:
            low[t] = min(low.get(t, doc), doc)
    return sorted(((d, f"{f:016x}", low.get(t)) for (d, _), f, t in zip(rows, fps, tops)), key=str)


def test_gray_rank_is_the_place_in_the_sequence():
    places = np.array([0, 1, 2, 3, 4, 1000, 2**63, 2**64 - 1], np.uint64)
    np.testing.assert_array_equal(gray_rank(places ^ (places >> np.uint64(1))), places)


def test_fingerprints_equal_counting_bits(prose):
    texts = ["", None, "One", "a b c", "a b c d", "A  B\tc\x0bd e", "É Ü ß ñ É", " ".join(prose(1, 700)), "same " * 1000, "x y z\x85w v"]
    got = simhash([None if t is None else t.encode() for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


def balls(rng, centers, members, flips):
    out = []
    for _ in range(centers):
        c = rng.getrandbits(64)
        for _ in range(members):
            x = c
            for b in rng.sample(range(64), rng.randrange(flips)):
                x ^= 1 << b
            out.append(x)
    return out


@pytest.mark.parametrize("case", ["balls", "crowd", "low bits", "one", "two"])
def test_links_connect_what_all_pairs_connect(case):
    rng = random.Random(case)
    fps = {
        "balls": balls(rng, 300, 3, 7) + [rng.getrandbits(64) for _ in range(300)],
        "crowd": balls(rng, 1, 900, 4) + balls(rng, 2, 200, 12),
        "low bits": [rng.getrandbits(11) for _ in range(900)],
        "one": [5],
        "two": [5, 7],
    }[case]
    fps = np.unique(np.array(fps, np.uint64))
    fps = fps[np.argsort(gray_rank(fps))]
    near = lambda x, y: (x ^ y).bit_count() <= 4
    want = components([int(f) for f in fps], near)

    def reached(pairs):
        place = {int(f): i for i, f in enumerate(fps)}
        edges = {frozenset((place[int(a)], place[int(b)])) for a, b in pairs}
        assert all(near(int(fps[min(e)]), int(fps[max(e)])) for e in edges)
        return components(list(range(len(fps))), lambda i, j: frozenset((i, j)) in edges)

    a, b = links(fps, None)
    assert len(a) < len(fps)  # a forest
    assert reached(zip(a, b)) == want
    if len(fps) > 2:
        # The same from two blocks and what is between them.
        half = len(fps) // 3
        parts = [links(fps[:half], None), links(fps[half:], None), links(fps[half:], fps[:half])]
        assert reached([p for a, b in parts for p in zip(a, b)]) == want


def test_nodes_hold_shared_bits_once():
    rng = random.Random(4)
    fps = np.array(sorted(rng.getrandbits(64) & 0xFFF0FF for _ in range(70)), np.uint64)
    index = GrayIndex(fps)
    for leaf in range(len(fps)):
        seen, node = 0, leaf
        for level, own in enumerate(index.own):
            mask = int(own[node])
            assert not seen & mask and (int(fps[leaf]) ^ int(index.patterns[level][node])) & mask == 0
            seen, node = seen | mask, node // grayindex.FAN
        assert seen == 2**64 - 1


@pytest.mark.parametrize("block", [grayindex.BLOCK_ROWS, 16])
def test_groups_equal_brute_force(clashing, prose, monkeypatch, block):
    monkeypatch.setattr(grayindex, "BLOCK_ROWS", block)
    rng = random.Random(9)
    rows = []
    for i in range(40):
        base = prose(i, 60)
        for j in range(3):
            words = list(base)
            for _ in range(j):
                words[rng.randrange(60)] = "changed"
            rows.append((i * 10 + j, " ".join(words)))
    rows += [(900 + i, "the very same text") for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (None, "alone and without id"), (None, rows[0][1]), (7, rows[5][1]), (1003, "w"), (7, rows[5][1])]
    got = near_groups(clashing(rows))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == expected(rows)
    assert {r.n_same for r in got.where("doc_id between 900 and 959").collect()} == {60}


def test_empty_table(clashing):
    assert near_groups(clashing([])).collect() == []


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op12_simhash"](spark, SF).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expected(docs)
