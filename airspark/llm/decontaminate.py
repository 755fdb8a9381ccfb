"""Benchmark decontamination by greedy string tiling.

Runs of ``tile`` words of the benchmark items are seeds; a document and an item that
share a seed are tiled: the longest common run of words that overlaps no earlier tile is
marked, again and again, until none of ``tile`` words is left. The share of an item's
words under tiles does not depend on their order, so reordered passages are caught.
Words are runs of letters and digits in lower case; runs are compared by rolling
hashes of word hashes.

Benchmark items are a query set: they are sent to the tasks in blocks of bounded size,
and each block meets all documents in one pass without a shuffle.

Defined cases: null texts have no words; an item without words covers nothing; items
shorter than ``tile`` words must occur whole; rows that repeat an id are judged each on
its own; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airspark.llm.common import arrow_schema, shingle_hashes, text_slices, word_hashes

TILE = 5
COVERAGE = 0.5
#: Characters of items sent to the tasks at once.
BLOCK_CHARS = 16 << 20

MATCHES = "doc_id long, item_id long, matched_words long, item_words long, coverage double, n_tiles long"
_MATCH_ARROW = arrow_schema(
    doc_id=pa.int64(), item_id=pa.int64(), matched_words=pa.int64(), item_words=pa.int64(), coverage=pa.float64(), n_tiles=pa.int64()
)


def common_runs(left: np.ndarray, right: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """All maximal common runs of at least ``k`` entries as (length, place left, place right)."""
    a, b = shingle_hashes(left, k), shingle_hashes(right, k)
    if len(left) < k or len(right) < k:
        return []
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    i = np.repeat(np.arange(len(a)), hi - lo)
    if not len(i):
        return []
    inside = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    j = order[np.repeat(lo, hi - lo) + inside]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    head = np.flatnonzero(np.append(True, (np.diff(i - j) != 0) | (np.diff(i) != 1)))
    sizes = np.diff(np.append(head, len(i)))
    return [(int(n) + k - 1, int(x), int(y)) for n, x, y in zip(sizes, i[head], j[head])]


def greedy_tiles(left: np.ndarray, right: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (length, place left, place right), longest first, ties by place."""
    waiting = [(-n, i, j) for n, i, j in common_runs(left, right, k)]
    heapq.heapify(waiting)
    used_left, used_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    tiles = []
    while waiting:
        n, i, j = heapq.heappop(waiting)
        n = -n
        free = ~(used_left[i : i + n] | used_right[j : j + n])
        if free.all():
            used_left[i : i + n] = used_right[j : j + n] = True
            tiles.append((n, i, j))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= k:
                heapq.heappush(waiting, (-int(b - a), i + int(a), j + int(a)))
    return tiles


def _tiled(docs: DataFrame, items: list[tuple[int, str]], tile: int, coverage: float) -> DataFrame:
    """Matches of all documents with one block of items."""
    words, at = word_hashes(pa.array([t for _, t in items], pa.large_string()), letters=True)
    ids = [i for i, _ in items]
    texts = [words[a:b] for a, b in zip(at[:-1], at[1:])]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in {min(tile, len(w)) for w in texts} - {0}:
        own = [(shingle_hashes(w, k), n) for n, w in enumerate(texts) if min(tile, len(w)) == k]
        keys = np.concatenate([s for s, _ in own])
        order = np.argsort(keys, kind="stable")
        seeds[k] = keys[order], np.concatenate([np.full(len(s), n) for s, n in own])[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                hashed, begin = word_hashes(part.column("text"), letters=True)
                doc_ids = part.column("doc_id").to_pylist()
                for d, doc in enumerate(doc_ids):
                    own = hashed[begin[d] : begin[d + 1]]
                    for k, (keys, of) in seeds.items():
                        if len(own) < k:
                            continue
                        runs = np.unique(shingle_hashes(own, k))
                        lo, hi = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
                        hit = lo < hi
                        for n in sorted({int(x) for a, b in zip(lo[hit], hi[hit]) for x in of[a:b]}):
                            tiles = greedy_tiles(own, texts[n], k)
                            matched, size = sum(t[0] for t in tiles), len(texts[n])
                            if matched >= coverage * size:
                                rows.append((doc, ids[n], matched, size, matched / size, len(tiles)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_MATCH_ARROW), _MATCH_ARROW)],
                    schema=_MATCH_ARROW,
                )

    return docs.mapInArrow(run, MATCHES)


def leaked_passages(
    docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Pairs of a document and a benchmark item of which at least ``coverage`` lies under tiles."""
    texts = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    items = benchmark.select(
        F.col("item_id").cast("long"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")
    )
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(chars) // block_chars + 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    # Each block is about block_chars characters, whatever the size of the benchmark.
    parts = [_tiled(texts, [tuple(r) for r in items.where(of == b).collect()], tile, coverage) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that match no benchmark item; rows without a doc_id are kept."""
    leaked = leaked_passages(docs, benchmark, **settings).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
