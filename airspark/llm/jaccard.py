"""Documents of similar word shingles, joined with signature trees.

1. Texts become sets of 64-bit shingle hashes. Equal sets are found by their digest and
   stand as one document from there on.
2. Routing. Two sets of Jaccard similarity t or more share one of their first
   n - ceil(t n) + 1 shingles in any common order. The order is by the counters of a
   sketch of fixed size, rare ones first, so shared passages rarely route. Documents that
   share a routing shingle form a unit with the smallest of them, and shingles of one
   smallest document have one unit; so similar documents meet in some unit. A frequent
   shingle's documents are salted before their smallest id is found.
3. Signature trees. The documents of a unit are leaves with token bitmaps; every
   node above holds the OR of its children's bitmaps and the range of their set sizes.
   Pairs of nodes are walked together from the top and pruned where sizes are too far
   apart, where the largest possible overlap is too small, or where all documents
   below are known to be connected. What is left at the leaves is compared exactly.
   A first walk needs bitmaps alone, which are a fraction of the texts: it splits each
   unit into groups whose bitmaps may overlap enough, named by their smallest document.
   Only the texts of such groups are fetched, and a second walk compares them exactly.
4. Units too large for one task are cut into blocks, and pairs of blocks are walked by
   different tasks; documents already linked to a pivot of the unit need no comparison
   among themselves.

Copies and connected documents are never expanded into all pairs.

Defined cases: null and empty texts have empty sets and are linked with nothing; texts
of fewer than ``k`` words are one shingle; rows without a doc_id are returned without a
component and linked with nothing; rows that repeat a doc_id are one node; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from airspark.llm.common import arrow_schema, mix, shingle_hashes, text_slices, word_hashes
from airspark.llm.components import connected
from airspark.session import written

WORDS = 5
PERCENT = 75
#: Counters of the frequency sketch; a power of two, whatever the input.
SKETCH = 1 << 20
CHUNK = 1 << 16
#: Rows of one routing shingle that meet in one task.
ROUTE_ROWS = 50_000
#: Shingles of a task's unit or block; above that a unit is cut.
UNIT_SHINGLES = 1_000_000
PIVOTS = 4
FAN = 8
#: Pairs of nodes that are looked at together.
PAIRS_AT_ONCE = 8192


# ---- sets -------------------------------------------------------------------

_BASE = "doc_id long, n_shingles long, digest binary, bits binary, chunk int, counts binary"
_BASE_ARROW = arrow_schema(doc_id=pa.int64(), n_shingles=pa.int64(), digest=pa.binary(), bits=pa.binary(), chunk=pa.int32(), counts=pa.binary())


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(at[:-1], at[1:])]


def _digest(own: np.ndarray) -> bytes:
    return blake2b(own.tobytes(), digest_size=16).digest()


def _on(own: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of a set in words of 64 bits; ``width`` is a power of two of 64 or more."""
    on = np.zeros(width, np.uint8)
    on[(own & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(on).view(np.uint64)


def bitmap(own: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits for each token of the set."""
    return _on(own, max(64, 1 << (2 * len(own) - 1).bit_length()))


def _base(docs: DataFrame, k: int) -> DataFrame:
    """A row with its bitmap per document, and per task the counters of its shingles in compressed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for part in text_slices(batch):
                own = sets_of(part.column("text"), k)
                if any(map(len, own)):
                    counts += np.bincount((np.concatenate(own) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in own], pa.int64()), pa.array([_digest(x) for x in own], pa.binary()), pa.array([bitmap(x).tobytes() if len(x) else None for x in own], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    schema=_BASE_ARROW,
                )
        if counts.any():
            chunks = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(-1, CHUNK)]
            n = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(chunks, pa.binary())],
                schema=_BASE_ARROW,
            )

    return docs.mapInArrow(run, _BASE)


def _frequencies(base: DataFrame) -> np.ndarray:
    """The counters of all documents' shingles; each bounds the documents of its shingles."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                own = np.frombuffer(zlib.decompress(data.as_buffer()), np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"]
            )

    rows = base.where("chunk is not null").select("chunk", "counts").repartition(SKETCH // CHUNK, "chunk")
    total = np.zeros((SKETCH // CHUNK, CHUNK), np.uint64)
    for r in rows.mapInArrow(add, "chunk int, counts binary").collect():  # SKETCH counters in all
        total[r["chunk"]] += np.frombuffer(r["counts"], np.uint64)
    return total.ravel().astype(np.float32)


# ---- routing ----------------------------------------------------------------

_ROUTE = "token long, salt int, frequent boolean, doc long"
_ROUTE_ARROW = arrow_schema(token=pa.int64(), salt=pa.int32(), frequent=pa.bool_(), doc=pa.int64())


def _routes(docs: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """The routing shingles of each document; a task names equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # SKETCH numbers
    usual = float(levels.mean() + 6 * np.sqrt(levels.mean()) + 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, named = shared.value, set()
        for batch in batches:
            for part in text_slices(batch):
                tokens, ids, salts, frequent = [], [], [], []
                for doc, own in zip(part.column("doc_id").to_pylist(), sets_of(part.column("text"), k)):
                    if not len(own):
                        continue
                    if (digest := _digest(own)) in named:
                        continue
                    if len(named) < 200_000:  # memory; a copy named twice is harmless
                        named.add(digest)
                    level = level_of[(own & np.uint64(SKETCH - 1)).astype(np.int64)]
                    first = len(own) - -(-percent * len(own) // 100) + 1
                    best = np.lexsort((own, level))[:first]
                    # The counter bounds the documents of a frequent shingle; usual ones are few.
                    salt = np.where(level[best] > usual, level[best] // ROUTE_ROWS + 1, 1).astype(np.uint64)
                    tokens.append(own[best].view(np.int64))
                    salts.append((mix(np.array([doc], np.int64).view(np.uint64))[0] % salt).astype(np.int32))
                    frequent.append(salt > 1)
                    ids.append(np.full(len(best), doc))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (tokens, salts, frequent, ids)], schema=_ROUTE_ARROW
                    )

    return docs.mapInArrow(run, _ROUTE)


def _route_edges(routes: DataFrame) -> DataFrame:
    """Each document and the smallest one that shares a routing shingle (and salt) with it."""
    group = Window.partitionBy("token", "salt")
    centered = routes.withColumn("m", F.min("doc").over(group)).where((F.col("doc") > F.col("m")) | F.col("frequent"))
    shared = written(centered.select(F.when(F.col("frequent"), F.col("token")).alias("token"), "doc", "m").distinct(), "routes")
    # The salted parts of a frequent shingle get the smallest of their centres in common.
    centers = shared.where("token is not null").groupBy("token").agg(F.min("m").alias("center"))
    frequent = shared.where("token is not null").join(centers, "token").select("doc", F.col("center").alias("m"))
    return shared.where("token is null").select("doc", "m").unionByName(frequent).where("doc <> m").select(F.col("doc").alias("a"), F.col("m").alias("b")).distinct()


# ---- trees ------------------------------------------------------------------


class SignatureTree:
    """Levels of nodes from the documents up. ``same`` is the label that all documents below share, or -1."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, slack, labels)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, s, same = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            least, most = np.minimum.reduceat(same, at), np.maximum.reduceat(same, at)
            self.levels.append(
                (np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(s, at), np.where(least == most, least, -1))
            )


def possible(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a pair of similar, not yet connected documents."""
    bits_a, low_a, high_a, slack_a, same_a = left
    bits_b, low_b, high_b, slack_b, same_b = right
    keep = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    keep &= (same_a[i] != same_b[j]) | (same_a[i] < 0)
    i, j, at = i[keep], j[keep], np.flatnonzero(keep)
    # Tokens whose bit the other node lacks cannot be shared; only tokens that fell on a
    # used bit of their own set (slack) escape that count.
    overlap = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1).astype(np.int64) + np.minimum(slack_a[i], slack_b[j])
    good = (100 + percent) * overlap >= percent * (low_a[i] + low_b[j])
    out = np.zeros(len(keep), bool)
    out[at[good]] = True
    return out


def candidate_pairs(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk both trees (or one with itself) from the top; yields pairs of documents."""
    alone = a is b
    work = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        x, y, i, j = work.pop()
        if len(i) > PAIRS_AT_ONCE:
            half = len(i) // 2
            work += [(x, y, i[:half], j[:half]), (x, y, i[half:], j[half:])]
            continue
        ok = possible(a.levels[x], b.levels[y], i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if x == y == 0:
            if alone:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        down_a, down_b = x > 0 and x >= y, y > 0 and y >= x
        grow = lambda n, at, down: (at[:, None] * FAN + np.arange(FAN), n) if down else (at[:, None], None)
        ci, ni = grow(len(a.levels[x - 1][1]) if down_a else 0, i, down_a)
        cj, nj = grow(len(b.levels[y - 1][1]) if down_b else 0, j, down_b)
        ii = np.repeat(ci, cj.shape[1], axis=1).ravel()
        jj = np.tile(cj, (1, ci.shape[1])).ravel()
        there = np.ones(len(ii), bool)
        if ni is not None:
            there &= ii < ni
        if nj is not None:
            there &= jj < nj
        if alone:
            there &= ii <= jj
        work.append((x - down_a, y - down_b, ii[there], jj[there]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union. Both are sorted."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Groups:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width, four bits for each token of the largest set."""
    width = 1 << max(9, int(np.ceil(np.log2(4 * max(map(len, sets))))))
    return np.stack([_on(own, width) for own in sets])


def bitmap_groups(sizes: np.ndarray, bits: list[np.ndarray], percent: int) -> Groups:
    """Groups of documents, by size and own bitmap, that hold every pair whose bitmaps may overlap enough.

    Bitmaps of one width make a tree; wider ones are folded to meet narrower ones.
    """
    groups = Groups(len(bits))
    widths = np.array([len(b) for b in bits])
    classes = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    stacks = {w: np.stack([bits[i] for i in members]) for w, members in classes.items()}
    for w, members in classes.items():
        # Documents near to one of the class are of its group; goes on while that pays.
        leaves = SignatureTree(stacks[w], sizes[members], members).levels[0]
        left = np.arange(len(members))
        while len(left) > FAN:
            near = possible(leaves, leaves, np.full(len(left) - 1, left[0]), left[1:], percent)
            for i in left[1:][near].tolist():
                groups.join(int(members[left[0]]), int(members[i]))
            rest = left[1:][~near]
            pays = len(rest) <= 0.75 * len(left)
            left = rest
            if not pays:
                break
    labels = groups.labels()

    def tree(w: int, narrow: int) -> tuple[SignatureTree, np.ndarray]:
        members = classes[w]
        folded = np.bitwise_or.reduce(stacks[w].reshape(len(members), w // narrow, narrow), axis=1)
        order = np.lexsort((sizes[members], labels[members]))
        return SignatureTree(folded[order], sizes[members][order], labels[members][order]), members[order]

    for w in classes:
        a, order_a = tree(w, w)
        for wide in classes:
            if wide < w or percent * sizes[classes[wide]].min() > 100 * sizes[classes[w]].max():
                continue
            b, order_b = (a, order_a) if wide == w else tree(wide, w)
            for i, j in candidate_pairs(a, b, percent):
                for x, y in zip(order_a[i].tolist(), order_b[j].tolist()):
                    groups.join(x, y)
    return groups


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> Groups:
    """Components of documents. With ``side``, only pairs across the two sides are compared;
    equal labels in ``known`` tell which documents are connected already."""
    groups = Groups(len(sets))
    if known is not None:
        first: dict[int, int] = {}
        for i, label in enumerate(known.tolist()):
            groups.join(first.setdefault(label, i), i)
    else:
        # Documents near to one of the unit are connected by it; goes on while that pays.
        left = list(range(len(sets)))
        while len(left) > FAN:
            pivot, before = left[0], len(left)
            rest = []
            for i in left[1:]:
                if similar(sets[pivot], sets[i], percent):
                    groups.join(pivot, i)
                else:
                    rest.append(i)
            left = rest
            if len(rest) > 0.75 * before:
                break
    labels, bits = groups.labels(), signatures(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    lowest = np.array([s[0] for s in sets])

    def tree(members: np.ndarray) -> tuple[SignatureTree, np.ndarray]:
        order = members[np.lexsort((sizes[members], lowest[members], labels[members]))]
        return SignatureTree(bits[order], sizes[order], labels[order]), order

    if side is None:
        a, order_a = tree(np.arange(len(sets)))
        b, order_b = a, order_a
    else:
        a, order_a = tree(np.flatnonzero(side == 0))
        b, order_b = tree(np.flatnonzero(side == 1))
    for i, j in candidate_pairs(a, b, percent):
        for x, y in zip(order_a[i].tolist(), order_b[j].tolist()):
            if groups.root(x) != groups.root(y) and similar(sets[x], sets[y], percent):
                groups.join(x, y)
    return groups


# ---- units ------------------------------------------------------------------

_SETS = "unit long, doc long, n long, tokens binary"
_SETS_ARROW = arrow_schema(unit=pa.int64(), doc=pa.int64(), n=pa.int64(), tokens=pa.large_binary())
_EDGE_ARROW = arrow_schema(a=pa.int64(), b=pa.int64())


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                own = sets_of(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("unit"), part.column("doc"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.large_binary())],
                    schema=_SETS_ARROW,
                )

    return docs.mapInArrow(run, _SETS)


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _edges(docs: list[int], groups: Groups) -> list[tuple[int, int]]:
    return [(docs[i], docs[r]) for i in range(len(docs)) if (r := groups.root(i)) != i]


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*edges) if edges else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE_ARROW)


_MEMBER = "doc_id long, unit long, n long, lo long, hi long"


def _split_units(percent: int):
    """All units of a bin by bitmaps alone: the groups of two documents or more that may link, named by their smallest."""

    def run(table: pa.Table) -> pa.Table:
        units, ids = np.asarray(table.column("unit")), np.asarray(table.column("doc_id"))
        order = np.lexsort((np.asarray(table.column("size")), ids, units))
        units, ids = units[order], ids[order]
        table = table.take(pa.array(order))
        sizes, bits = np.asarray(table.column("size")), _unpack(table.column("bits"))
        named = np.full(len(units), -1)
        cuts = np.flatnonzero(np.append(True, np.diff(units) != 0))
        for at, to in zip(cuts.tolist(), np.append(cuts[1:], len(units)).tolist()):
            named[at:to] = at + bitmap_groups(sizes[at:to], bits[at:to], percent).labels()
        several = np.bincount(named, minlength=len(units))[named] > 1
        out = table.select(["doc_id", "n", "lo", "hi"]).append_column("unit", pa.array(ids[named]))
        return out.select(["doc_id", "unit", "n", "lo", "hi"]).filter(pa.array(several))

    return run


def _join_units(k: int, percent: int):
    """All units of a bin, one after the other. Their texts travel, not their sets, which are larger."""

    def run(table: pa.Table) -> pa.Table:
        units = np.asarray(table.column("unit"))
        order = np.lexsort((np.asarray(table.column("doc")), units))
        table, units = table.take(pa.array(order)), units[order]
        docs, texts, edges = table.column("doc").to_pylist(), table.column("text").combine_chunks(), []
        cuts = np.flatnonzero(np.append(True, np.diff(units) != 0))
        for at, to in zip(cuts, np.append(cuts[1:], len(units))):
            edges += _edges(docs[at:to], linked(sets_of(texts.slice(at, to - at), k), percent))
        return _edge_table(edges)

    return run


def _join_blocks(percent: int):
    """A pair of blocks of a large unit; equal labels are connected already."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc")
        docs, labels = table.column("doc").to_pylist(), np.asarray(table.column("label"))
        side = np.asarray(table.column("side"))
        one = (side == side[0]).all()
        if one and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            return _edge_table([])
        found = linked(_unpack(table.column("tokens")), percent, None if one else side, labels)
        return _edge_table(_edges(docs, found))

    return run


def _near_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """Adds ``label``: the first pivot of its unit that a document is similar to, else itself.

    Pivots that are similar to each other count as one.
    """
    pick = F.min_by(F.struct("doc", "tokens"), F.struct(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)), "doc"))
    quarter = F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(PIVOTS))
    pivots = rows.groupBy("unit", quarter.alias("q")).agg(pick.alias("p")).groupBy("unit").agg(F.collect_list("p").alias("pivots"))  # PIVOTS of each
    schema = arrow_schema(unit=pa.int64(), doc=pa.int64(), n=pa.int64(), tokens=pa.large_binary(), label=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = []
            for doc, own, near in zip(batch.column("doc").to_pylist(), _unpack(batch.column("tokens")), batch.column("pivots")):
                label = doc
                known = sorted((p["doc"], p["tokens"]) for p in near.as_py())
                sets = [np.frombuffer(t, np.uint64) for _, t in known]
                for (pivot, _), tokens in zip(known, sets):
                    if similar(own, tokens, percent):
                        first = next(i for i, s in enumerate(sets) if similar(s, tokens, percent))
                        label = known[first][0]
                        break
                labels.append(label)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("unit", "doc", "n", "tokens")), pa.array(labels, pa.int64())], schema=schema)

    return rows.join(pivots, "unit").mapInArrow(run, _SETS + ", label long")


def _large_units(rows: DataFrame, percent: int, unit_shingles: int) -> DataFrame:
    """Edges inside units that are cut into blocks."""
    rows = written(_near_pivots(rows, percent), "near")
    star = rows.where("label <> doc").select(F.col("doc").alias("a"), F.col("label").alias("b"))
    # Pivots carry their own label, and so do the documents that no pivot is similar to.
    groups = rows.groupBy("unit", "label").agg(F.sum("n").alias("n"))
    usual = groups.groupBy("unit").agg(F.max_by("label", F.struct("n", "label")).alias("usual"), F.sum("n").alias("total"), F.max("n").alias("most"))
    sized = rows.join(usual, "unit").where("total > most")  # one label: all are connected
    free = F.col("label") != F.col("usual")
    parts = lambda n: F.greatest(F.ceil(n / unit_shingles), F.lit(1)).cast("int")
    n_free, n_usual = parts(F.col("total") - F.col("most")), parts(F.col("most"))
    block = F.when(free, F.pmod(F.xxhash64("doc"), n_free)).otherwise(n_free + F.pmod(F.xxhash64("doc"), n_usual)).cast("int")
    # Blocks of the usual label meet only blocks of the others.
    others = F.when(free, F.sequence(F.lit(0), n_free + n_usual - 1)).otherwise(F.sequence(F.lit(0), n_free - 1))
    pairs = sized.withColumn("block", block).withColumn("other", F.explode(others))
    keyed = pairs.select(
        "unit", "doc", "tokens", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    met = keyed.groupBy("unit", "i", "j").applyInArrow(_join_blocks(percent), "a long, b long")
    return star.unionByName(met)


# ---- the join ---------------------------------------------------------------


def _weights(asked: DataFrame, percent: int, unit_shingles: int) -> tuple[DataFrame, int, int]:
    """Shingles of each unit that may link something, those of the largest, and the number of bins for all."""
    weights = asked.groupBy("unit").agg(F.sum("n").alias("weight"), F.count("*").alias("docs"), F.min("hi").alias("low"), F.max("lo").alias("high"))
    # A unit of two whose sizes are too far apart links nothing (a repeated id may have several sizes).
    weights = weights.where(f"docs > 2 or (docs = 2 and 100 * low >= {percent} * high)").select("unit", "weight")
    weights = written(weights, "weights")
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"), F.coalesce(F.max("weight"), F.lit(0)).alias("most")).first()
    return weights, int(total["most"]), int(total["n"]) // unit_shingles + 1


def similar_documents(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest connected doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(_base(texts, k), "shingles")
    counts = _frequencies(base)
    rows = base.where("chunk is null")
    sized = rows.select("doc_id", "n_shingles")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).where("first <> _last").select("digest", "first")
    copies = written(known.join(firsts, "digest").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "copies")
    routes = _route_edges(_routes(texts.where("doc_id is not null"), counts, k, percent))
    # Copies are named by the first of them.
    first_of = copies.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("first"))
    named = routes.withColumnRenamed("a", "node").join(first_of, "node", "left").select(F.coalesce("first", "node").alias("node"), "b")
    named = named.join(first_of.select(F.col("node").alias("b"), "first"), "b", "left").select("node", F.coalesce("first", "b").alias("root"))
    members = named.where("node <> root").unionByName(named.select(F.col("root").alias("node"), "root"))
    # A document's unit and size are narrow rows; a unit of one document needs no comparison.
    asked = written(
        members.distinct().select(F.col("node").alias("doc_id"), F.col("root").alias("unit"))
        .join(known.groupBy("doc_id").agg(F.sum("n_shingles").alias("n"), F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi")), "doc_id"),
        "members",
    )
    weights, most, bins = _weights(asked, percent, unit_shingles)
    large = F.col("weight") > 2 * unit_shingles
    bin_of = lambda n: F.pmod(F.xxhash64("unit"), F.lit(n)).alias("bin")
    # Merge joins throughout: what moves is in proportion to the input at every size.
    bits = known.select("doc_id", F.col("n_shingles").alias("size"), "bits")
    small = bits.join(asked.join(weights.where(~large), "unit").drop("weight").hint("merge"), "doc_id")
    asked = written(
        small.groupBy(bin_of(bins)).applyInArrow(_split_units(percent), _MEMBER)
        .unionByName(asked.join(weights.where(large), "unit").select("doc_id", "unit", "n", "lo", "hi")).distinct(),
        "groups",
    )
    weights, most, bins = _weights(asked, percent, unit_shingles)

    def rows_of(which) -> DataFrame:
        wanted = written(asked.join(weights.where(which), "unit").select("doc_id", "unit"), "wanted")
        return texts.join(wanted.hint("merge"), "doc_id").select("unit", F.col("doc_id").alias("doc"), "text")

    edges = rows_of(~large).groupBy(bin_of(bins)).applyInArrow(_join_units(k, percent), "a long, b long")
    if most > 2 * unit_shingles:
        edges = edges.unionByName(_large_units(_sets(rows_of(large), k), percent, unit_shingles))
    found = connected(edges.unionByName(copies)).withColumnRenamed("node", "doc_id")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return sized.join(found, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """Keep the document with the smallest id of every component, and all rows without an id."""
    found = similar_documents(docs, **settings)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
