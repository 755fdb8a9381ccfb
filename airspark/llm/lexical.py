"""Ranked lexical search over documents grouped by their length normaliser.

A document's score for an item sums, over the item's terms, the term's weight times an
impact that depends only on how often the term occurs (tf) and on the document's
normaliser m. Documents are therefore sorted by m: all of equal m are a stratum, and in a
stratum the postings of a term are kept by tf, so that an impact is computed once per
(m, term, tf). A term's largest tf bounds what it can add anywhere in the stratum; the sum
of these bounds over an item's terms bounds the stratum. An item visits strata from the
highest bound down, and none whose bound is below its worst kth score so far.

Items are a query set: their terms are sent to the tasks in blocks of ``BLOCK_CHARS``
characters, and each block meets all documents. A first pass visits only the best stratum
of every piece and gives each item a kth score to start from; the second visits the rest.
Strata follow from a range partitioning by m and a hash, so a stratum with very many
documents lies in several tasks.

Defined cases: a null text has no terms; equal rows of items count once, an id with
several texts has a ranking for each; repeated documents are ranked each on its own; of
equal scores the smaller id comes first, rows without an id last; an empty table gives an
empty result; other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from airspark.llm.common import arrow_schema, text_slices, word_hashes
from airspark.session import written

TOP = 50
#: Characters of items that are searched for together.
BLOCK_CHARS = 16 << 20
#: Postings indexed at once, and scores (items by documents) held at once.
PIECE_POSTINGS, CELLS = 1 << 20, 1 << 21
#: Strata an item visits between two looks at its kth score: this many, then thrice as many each time.
FIRST_VISITS, MORE_VISITS = 1, 3

RANKING = "item_id long, rank int, doc_id long, score long"
_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
_POSTINGS_ARROW = arrow_schema(doc_id=pa.int64(), n=pa.int64(), terms=pa.list_(pa.int32()), tfs=pa.list_(pa.int32()))
_HITS = "item int, doc_id long, score long"
_HITS_ARROW = arrow_schema(item=pa.int32(), doc_id=pa.int64(), score=pa.int64())


class Items:
    """The terms of some items: a sorted vocabulary, and the items of each term."""

    def __init__(self, texts: list[str | None]):
        words, at = word_hashes(pa.array(texts, pa.large_string()), letters=True)
        self.size = len(texts)
        self.vocabulary = np.unique(words)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        pairs = np.unique(np.searchsorted(self.vocabulary, words) * max(len(texts), 1) + owner)
        self.item = pairs % max(len(texts), 1)
        self.begin = np.searchsorted(pairs // max(len(texts), 1), np.arange(len(self.vocabulary) + 1))

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of ``terms`` all items that hold it: places in ``terms``, and items."""
        n = self.begin[terms + 1] - self.begin[terms]
        place = np.repeat(np.arange(len(terms)), n)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, self.item[self.begin[terms][place] + inside]


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per document its number ``n`` of terms, and which terms of a vocabulary it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, at = word_hashes(part.column("text"), letters=True)
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                term = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                known = vocabulary[term] == words
                pairs, tf = np.unique(owner[known] * len(vocabulary) + term[known], return_counts=True)
                begin = pa.array(np.searchsorted(pairs // len(vocabulary), np.arange(len(at))), pa.int32())
                lists = [pa.ListArray.from_arrays(begin, pa.array(v, pa.int32())) for v in (pairs % len(vocabulary), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), *lists], schema=_POSTINGS_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _POSTINGS)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence count is worth at a normaliser, in whole numbers."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and which range each is of."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of], of


class Piece:
    """The index of some documents in order of m: strata, and in them postings by term and tf."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, begin: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        self.doc_ids = doc_ids
        values, stratum = np.unique(m, return_inverse=True)
        self.n_strata = len(values)
        owner = np.repeat(np.arange(len(m)), np.diff(begin))
        order = np.lexsort((tfs, terms, stratum[owner]))
        s, t, f = stratum[owner][order], terms[order], tfs[order]
        self.doc = owner[order]
        head = np.flatnonzero(np.concatenate(([len(s) > 0], (np.diff(s) != 0) | (np.diff(t) != 0) | (np.diff(f) != 0))))
        # One run per (stratum, term, tf): its gain is computed once for all its documents.
        self.run_stratum, self.run_term, self.run_begin = s[head], t[head], head
        self.run_end = np.append(head[1:], len(s))
        self.run_gain = weights[self.run_term] * impact(f[head].astype(np.int64), values[self.run_stratum])
        # The last run of a term in a stratum has its largest tf.
        last = np.flatnonzero(np.append((np.diff(self.run_stratum) != 0) | (np.diff(self.run_term) != 0), True))[: len(head)]
        self.top = last if len(head) else head

    def bounds(self, items: Items) -> np.ndarray:
        """The highest score that a document of each stratum (columns) can have for each item (rows)."""
        place, item = items.of(self.run_term[self.top])
        out = np.zeros((items.size, self.n_strata), np.int64)
        np.add.at(out, (item, self.run_stratum[self.top][place]), self.run_gain[self.top][place])
        return out

    def scores(self, items: Items, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Scores of blocks of items (rows, from the given item) in the ``wanted`` (item, stratum) pairs."""
        # Runs of wanted strata alone are looked at.
        runs = np.flatnonzero(wanted.any(axis=0)[self.run_stratum])
        place, item = items.of(self.run_term[runs])
        run = runs[place]
        keep = wanted[item, self.run_stratum[run]]
        order = np.argsort(item[keep], kind="stable")
        run, item = run[keep][order], item[keep][order]
        width = len(self.doc_ids)
        height = max(1, CELLS // max(width, 1))
        for first in range(0, items.size, height):
            lo, hi = np.searchsorted(item, (first, first + height))
            if lo == hi:
                continue
            cells = np.zeros(min(height, items.size - first) * width, np.int64)
            # Postings of a few runs at a time: their number may exceed that of the cells.
            edges = np.cumsum(self.run_end[run[lo:hi]] - self.run_begin[run[lo:hi]])
            cuts = np.unique(np.searchsorted(edges, np.arange(0, edges[-1] + CELLS, CELLS)))
            for a, b in zip(cuts, np.append(cuts[1:], hi - lo)):
                r, i = run[lo + a : lo + b], item[lo + a : lo + b] - first
                at, of = _spread(self.run_begin[r], self.run_end[r])
                np.add.at(cells, i[of] * width + self.doc[at], self.run_gain[r][of])
            yield first, cells.reshape(-1, width)


class Best:
    """The ``k`` best documents of every item so far, and the score a further one must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, first: int, cells: np.ndarray, doc_ids: np.ndarray) -> None:
        rows, width = cells.shape
        least = np.maximum(self.least[first : first + rows], 1)
        if width > self.k:
            least = np.maximum(least, np.partition(cells, width - self.k, axis=1)[:, width - self.k])
        i, d = np.nonzero(cells >= least[:, None])
        item = np.concatenate((self.item, i + first))
        doc, score = np.concatenate((self.doc, doc_ids[d])), np.concatenate((self.score, cells[i, d]))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        full = place == self.k - 1
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])


#: Stands for a missing id: it comes after all others.
_NO_ID = np.iinfo(np.int64).max


def _pieces(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[Piece]:
    """Indexes of at most ``PIECE_POSTINGS`` postings (or one document) of a batch in order of m."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    begin = terms.offsets.to_numpy().astype(np.int64)
    ids = np.asarray(batch.column("doc_id").fill_null(_NO_ID))
    m = np.asarray(batch.column("m"))
    term, tf = terms.values.to_numpy(), tfs.values.to_numpy()
    shift = tfs.offsets.to_numpy().astype(np.int64)[0] - begin[0]
    start = 0
    while start < len(ids):
        stop = max(start + 1, int(np.searchsorted(begin, begin[start] + PIECE_POSTINGS, "right")) - 1)
        a, b = begin[start], begin[stop]
        yield Piece(ids[start:stop], m[start:stop], begin[start : stop + 1] - a, term[a:b], tf[a + shift : b + shift], weights)
        start = stop


def _visits(bounds: np.ndarray, best: Best) -> Iterator[np.ndarray]:
    """Which (item, stratum) pairs to look at next, by falling bounds, until none can add anything."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(bounds.shape[1])[None, :], axis=1)
    done, more = 0, FIRST_VISITS
    while done < bounds.shape[1]:
        open_ = (bounds > 0) & (bounds >= best.least[:, None]) & (place >= done)
        if not open_.any():
            return
        yield open_ & (place < done + more)
        done, more = done + more, more * MORE_VISITS


def search(strata: DataFrame, items: Items, weights: np.ndarray, least: np.ndarray, k: int, first_visits_only: bool) -> DataFrame:
    """Each task's best documents of every item, among the strata whose bounds reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least, k)
        for batch in batches:
            for piece in _pieces(batch, weights):
                for wanted in _visits(piece.bounds(items), best):
                    for first, cells in piece.scores(items, wanted):
                        best.add(first, cells, piece.doc_ids)
                    if first_visits_only:
                        break
        doc = pa.array(best.doc, mask=best.doc == _NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), doc, pa.array(best.score)], schema=_HITS_ARROW)

    return strata.mapInArrow(run, _HITS)


def _best_of_all(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ranked(docs: DataFrame, rows: list[tuple[int, str]], k: int) -> DataFrame | None:
    """Rankings for one block of items."""
    items = Items([t for _, t in rows])
    if not len(items.vocabulary):
        return None
    held = written(postings(docs, items.vocabulary), "postings")
    sizes = held.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L")).first()
    n_docs, length = sizes["N"], sizes["L"]
    if not n_docs:
        return None
    # One row per term of the block of items.
    counts = held.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    weights = np.zeros(len(items.vocabulary), np.int64)
    for t, df in counts:
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    m = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {length}L")
    strata = held.where(F.size("terms") > 0).select("doc_id", m.cast("long").alias("m"), "terms", "tfs")
    strata = written(strata.repartitionByRange("m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m"), "strata")
    none = np.zeros(items.size, np.int64)
    start = _best_of_all(search(strata, items, weights, none, k, True), k)
    least = none.copy()
    for item, score in start.where(F.col("rank") == k).select("item", "score").collect():
        least[item] = score
    ids = np.array([-1 if i is None else i for i, _ in rows], np.int64)
    unnamed = np.array([i is None for i, _ in rows])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = np.asarray(batch.column("item"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[item], mask=unnamed[item]), batch.column("rank"), batch.column("doc_id"), batch.column("score")],
                names=["item_id", "rank", "doc_id", "score"],
            )

    found = _best_of_all(search(strata, items, weights, least, k, False), k)
    return found.mapInArrow(named, RANKING)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).distinct()
    out = spark.createDataFrame([], RANKING)
    block, chars = [], 0
    # Items come one partition after the other: the driver holds one block of them.
    for row in texts.toLocalIterator():
        if block and chars + len(row["text"]) > BLOCK_CHARS:
            found = _ranked(docs, block, k)
            out = out if found is None else out.unionByName(found)
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    found = _ranked(docs, block, k) if block else None
    return out if found is None else out.unionByName(found)
