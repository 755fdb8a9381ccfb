"""Near-duplicate documents by SimHash and a hierarchical index in Gray order.

A fingerprint has bit i set if over half of the text's shingle hashes (XXH64, seed 42)
have it. Fingerprints are sorted by their rank in the Gray sequence, so that neighbours
differ in few bits, and cut into blocks. A block is a tree of groups of ``FAN``
neighbours: a node holds the bits that all its fingerprints share (mask and pattern),
without those that a node above it holds already. A search adds up the differences of a
fingerprint from one node to the next and leaves a whole group out as soon as they exceed
``BITS``. The topmost nodes, one per block, tell which pairs of blocks can hold links at
all; only those meet in a task.

Of a group in which all are connected already nothing more is compared, and a task hands
on only the links that connect something new, so a crowd of near copies never becomes all
its pairs. Components follow from these links.

Defined cases: a null text or one without words has fingerprint zero, which is linked like
any other; a text with fewer words than a shingle has one shingle of them all; rows that
repeat an id or a text count each; a null id is no component id unless all ids of its
component are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from airspark.llm.common import arrow_schema, text_slices
from airspark.llm.components import connected
from airspark.session import written

SHINGLE = 4
SEED = 42
BITS = 4
#: Children of an index node.
FAN = 4
#: Blocks of an index. More than the fewest are made so that none holds more than
#: ``BLOCK_ROWS`` fingerprints, and blocks grow only where that takes more than the most.
FEWEST_BLOCKS, MOST_BLOCKS = 16, 1024
BLOCK_ROWS = 1 << 20
#: Fingerprints that start a walk together, and nodes looked at in one step.
QUERIES, STEP = 256, 1 << 18
#: Keys with more rows than this share of all are joined by broadcast: at most as many keys.
HOT_KEYS = 10_000

_KEYS_ARROW = arrow_schema(doc_id=pa.int64(), fp=pa.int64(), rank=pa.int64())
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_TOP = np.uint64(1 << 63)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the Gray sequence."""
    rank = fps.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def shingle_values(text: bytes, k: int = SHINGLE) -> list[int]:
    """Hashes of the shingles of a text, in order and with repeats."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    hashed = xxhash.xxh64_intdigest
    flat, n = b" ".join(words), len(words)
    if n <= k:
        return [hashed(flat, SEED)] if n else []
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    return [hashed(flat[a:b], SEED) for a, b in zip((ends - sizes)[: n - k + 1].tolist(), ends[k - 1 :].tolist())]


def _bit_counts(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the values of every text."""
    counts = np.zeros((len(begin) - 1, 64), np.int64)
    size = np.diff(begin)
    # Runs of at most 255 values of one text, so that a byte can count them.
    owner = np.repeat(np.arange(len(size)), (size + 254) // 255)
    first = np.searchsorted(owner, np.arange(len(size)))
    starts = begin[:-1][owner] + 255 * (np.arange(len(owner)) - first[owner])
    for a in range(0, len(starts), 512):
        some = starts[a : a + 512]
        stop = starts[a + 512] if a + 512 < len(starts) else len(values)
        bits = np.unpackbits(values[some[0] : stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(counts, owner[a : a + 512], np.add.reduceat(bits, some - some[0], axis=0, dtype=np.uint8).astype(np.int64))
    return counts


def simhash(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprints of some texts."""
    found = [shingle_values(t, k) if t else [] for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
    values = np.fromiter((h for f in found for h in f), np.uint64, int(begin[-1]))
    most = _bit_counts(values, begin) * 2 > np.diff(begin)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id``, fingerprint ``fp`` and its Gray ``rank`` (both as signed longs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                fps = simhash(part.column("text").cast(pa.binary()).to_pylist(), k)
                # The top bit is turned over so that signed order is the order of ranks.
                ranks = gray_rank(fps) ^ _TOP
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(fps.view(np.int64)), pa.array(ranks.view(np.int64))], schema=_KEYS_ARROW
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, rank long")


class GrayIndex:
    """The nodes of one block, level by level from the fingerprints up."""

    def __init__(self, fps: np.ndarray):
        patterns, masks = [fps], [np.full(len(fps), _ALL)]
        while len(patterns[-1]) > FAN:
            p, m = patterns[-1], masks[-1]
            lack = -len(p) % FAN
            p, m = (np.concatenate((x, np.repeat(x[-1:], lack))).reshape(-1, FAN) for x in (p, m))
            same = np.bitwise_and.reduce(m, axis=1) & ~np.bitwise_or.reduce(p ^ p[:, :1], axis=1)
            patterns.append(p[:, 0] & same)
            masks.append(same)
        # A node keeps only the bits that no node above it holds.
        self.own = [m & ~np.repeat(up, FAN)[: len(m)] for m, up in zip(masks, masks[1:])] + [masks[-1]]
        self.patterns = patterns

    def __len__(self) -> int:
        return len(self.patterns[0])

    def labels(self, groups: np.ndarray) -> list[np.ndarray]:
        """Per level and node the group of all its fingerprints, or -1 if they are of several."""
        out = [groups]
        for level in self.patterns[1:]:
            below = np.concatenate((out[-1], np.repeat(out[-1][-1:], len(level) * FAN - len(out[-1])))).reshape(-1, FAN)
            out.append(np.where((below == below[:, :1]).all(axis=1), below[:, 0], -1))
        return out


class Groups:
    """Connected fingerprints: every entry's label is the same within a group."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join a[i] with b[i]; the indices i of pairs that were not connected before."""
        x, y = self.label[a], self.label[b]
        _, first = np.unique(np.minimum(x, y) * len(self.label) + np.maximum(x, y), return_index=True)
        first = first[x[first] != y[first]]
        above: dict[int, int] = {}

        def top(n: int) -> int:
            while (up := above.get(n, n)) != n:
                above[n] = above.get(up, up)
                n = up
            return n

        used = []
        for i, u, v in zip(first.tolist(), x[first].tolist(), y[first].tolist()):
            u, v = top(u), top(v)
            if u != v:
                above[max(u, v)] = min(u, v)
                used.append(i)
        if used:
            new = np.arange(len(self.label))
            moved = np.fromiter(above, np.int64, len(above))
            new[moved] = [top(n) for n in moved.tolist()]
            self.label = new[self.label]
        return np.array(used, np.int64)


def _neighbours(groups: Groups, fps: np.ndarray, bits: int, at: int = 0) -> np.ndarray:
    """Join neighbours in Gray order that are close; the places of those newly joined."""
    near = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= bits)
    return near[groups.join(near + at, near + 1 + at)]


def links(block: np.ndarray, others: np.ndarray | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of a block with those of another, or each other.

    Both are in Gray order. The pairs are a forest: no link follows from the others, given
    that neighbours of the same block are known to be connected if ``others`` is given.
    """
    index, size = GrayIndex(block), len(block)
    queries = block if others is None else others
    groups = Groups(size if others is None else size + len(others))
    at = 0 if others is None else size
    joined = _neighbours(groups, block, bits)
    found_a, found_b = ([block[joined]], [block[joined + 1]]) if others is None else ([], [])
    if others is not None:
        _neighbours(groups, others, bits, at)
    named = index.labels(groups.label[:size])
    top = len(index.patterns) - 1
    for start in range(0, len(queries), QUERIES):
        q = np.arange(start, min(start + QUERIES, len(queries)))
        width = len(index.patterns[top])
        waiting = [(top, np.repeat(q, width), np.tile(np.arange(width), len(q)), np.zeros(len(q) * width, np.uint8))]
        while waiting:
            level, q, node, differ = waiting.pop()
            if len(q) > STEP:
                waiting += [(level, q[STEP:], node[STEP:], differ[STEP:])]
                q, node, differ = q[:STEP], node[:STEP], differ[:STEP]
            keep = named[level][node] != groups.label[q + at]
            if others is None:
                keep &= node * FAN**level < q  # every pair once
            q, node, differ = q[keep], node[keep], differ[keep]
            differ = differ + np.bitwise_count((queries[q] ^ index.patterns[level][node]) & index.own[level][node])
            keep = differ <= bits
            q, node, differ = q[keep], node[keep], differ[keep]
            if not len(q):
                continue
            if level:
                kids = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = kids < len(index.patterns[level - 1])
                waiting.append((level - 1, np.repeat(q, FAN)[real], kids[real], np.repeat(differ, FAN)[real]))
                continue
            new = groups.join(node, q + at)
            if len(new):
                found_a.append(block[node[new]])
                found_b.append(queries[q[new]])
                named = index.labels(groups.label[:size])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _cuts(keys: DataFrame, n: int) -> np.ndarray:
    """Ranks at which the blocks after the first begin, about equally many fingerprints apart."""
    blocks = min(MOST_BLOCKS, max(FEWEST_BLOCKS, -(-n // BLOCK_ROWS)))
    shares = [i / blocks for i in range(1, blocks)]
    found = keys.agg(F.percentile_approx("rank", shares, 100 * MOST_BLOCKS)).first()[0]
    return np.unique(np.array(found, np.int64))


def fingerprint_links(keys: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """Links a, b of distinct fingerprints (``fp``, ``rank``) that connect all within ``bits``."""
    cuts = _cuts(keys, n)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.searchsorted(cuts, np.asarray(batch.column("rank")), "right")
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("fp")], names=["block", "fp"])

    # The topmost nodes: at most MOST_BLOCKS rows, for the bits that a block shares.
    tops = keys.mapInArrow(blocks, "block long, fp long").groupBy("block").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any"))
    rows = sorted(tuple(r) for r in tops.collect())
    block = np.array([r[0] for r in rows], np.int64)
    ones, any_ = (np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in (1, 2))
    mask = ~(any_ ^ ones)
    meets: dict[int, list[tuple[int, int]]] = {int(b): [] for b in block}
    for i, b in enumerate(block.tolist()):
        close = np.bitwise_count((ones[: i + 1] ^ ones[i]) & mask[: i + 1] & mask[i]) <= bits
        for c in block[: i + 1][close].tolist():
            unit = b * MOST_BLOCKS + c
            meets[b].append((unit, 0))
            if c != b:
                meets[c].append((unit, 1))
    table = {b: np.array(m, np.int64).reshape(-1, 2) for b, m in meets.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, fp = np.asarray(batch.column("rank")), np.asarray(batch.column("fp"))
            place = np.searchsorted(cuts, rank, "right")
            for b in np.unique(place):
                own = np.flatnonzero(place == b)
                for unit, side in table[int(b)].tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), unit)), pa.array(np.full(len(own), side, np.int32)), pa.array(fp[own])],
                        names=["unit", "side", "fp"],
                    )

    def meet(unit: pa.Table) -> pa.Table:
        side, fp = np.asarray(unit.column("side")), np.asarray(unit.column("fp")).view(np.uint64)
        left, right = (x[np.argsort(gray_rank(x))] for x in (fp[side == 0], fp[side == 1]))
        a, b = links(left, right if len(right) else None, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keys.mapInArrow(deal, "unit long, side int, fp long").groupBy("unit").applyInArrow(meet, "a long, b long")


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``keyed``, one row per key, of which ``n`` counts the key's rows.

    Keys that hold one in ``HOT_KEYS`` of all rows or more, so at most ``HOT_KEYS`` keys,
    are sent to all tasks; the rows of no other key are many.
    """
    least = max(HOT_KEYS, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col("n") >= least))
    cold = keyed.where(F.col("n") < least)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def near_groups(docs: DataFrame, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``n_same`` of every row.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``bits`` bits, ``n_same`` the number of rows with the same fingerprint.
    """
    rows = written(fingerprints(docs, k), "fingerprints")
    keys = written(rows.groupBy("fp", "rank").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fingerprint-keys")
    counted = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    n, total = counted["keys"], counted["rows"]
    if n:
        # Only fingerprints that are linked have a root; all others are their own component.
        found = connected(fingerprint_links(keys, n, bits))
        roots = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        linked = written(keys.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "low", "n"), "fingerprint-roots")
        lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
        named = spread_join(linked.select("fp", "root", F.col("n").alias("n_same")), lowest, "root", n).select(
            "fp", "component_id", F.col("n_same").alias("n")
        )
        single = keys.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"), "n")
        named = written(named.unionByName(single), "fingerprint-names")
    else:
        named = keys.select("fp", F.col("low").alias("component_id"), "n")
    return spread_join(rows.select("doc_id", "fp"), named, "fp", total).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("n_same")
    )
