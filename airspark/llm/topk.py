"""Exact top-k inner products with two cover trees.

The first level of the tree is shared: pivots (a sample of ``PIVOTS`` rows chosen by
hash) cover all rows, each row belonging to its nearest pivot with a known radius.
Blocks of a cluster meet blocks of queries in one task, which builds a cover tree on
either side and walks both together. A pair of nodes is left out when even its best
possible product, by centres and covering radii, is below the worst kth score of the
query group. A query's first bound is its kth score among the pivots, which are rows
too; clusters are left out by it before any row is shuffled.

Defined cases: rows without an id, and vectors that are null or hold null or non-finite
components, take no part; vectors meet vectors of their own length only; all rows with
the query's id are the query's own; rows that repeat both id and vector count once;
ties go to the smaller id; an empty table gives an empty result; other columns are not
read. Scores must fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from airspark.llm.common import arrow_schema
from airspark.session import written

PIVOTS = 64
#: Rows of a block of candidates, and of queries.
BLOCK_ROWS = 4096
LEAF_ROWS = 192


class Node:
    __slots__ = ("center", "radius", "norm", "rows", "kids")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray, kids: list["Node"]):
        self.center, self.radius, self.rows, self.kids = center, radius, rows, kids
        self.norm = float(np.sqrt(center @ center))


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Node:
    """A node covers its rows within its radius; its children's centres are a net of half the radius."""
    center = points[rows[0]]
    far = np.sqrt(np.maximum(((points[rows] - center) ** 2).sum(axis=1), 0.0))
    radius = float(far.max())
    if len(rows) <= leaf or radius == 0.0:
        return Node(center, radius, rows, [])
    owner, near = np.zeros(len(rows), dtype=np.int64), far
    centers = 1
    while True:
        i = int(near.argmax())
        if near[i] <= radius / 2 or centers * leaf >= 4 * len(rows):
            break
        own = np.sqrt(((points[rows] - points[rows[i]]) ** 2).sum(axis=1))
        closer = own < near
        owner[closer], near = centers, np.minimum(near, own)
        centers += 1
    kids = [cover_tree(points, rows[owner == c], leaf) for c in range(centers) if (owner == c).any()]
    if len(kids) == 1:
        half = len(rows) // 2
        kids = [cover_tree(points, rows[:half], leaf), cover_tree(points, rows[half:], leaf)]
    return Node(center, radius, rows, kids)


def best_product(q: Node, c: Node) -> float:
    """No product of a query below ``q`` and a row below ``c`` is larger; rounding is allowed for."""
    bound = float(q.center @ c.center) + q.radius * c.norm + c.radius * q.norm + q.radius * c.radius
    return bound + 1e-9 * abs(bound) + 1e-6


class Search:
    """The k best rows of every query so far: scores, and ids among equal scores."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
        self.queries, self.query_ids, self.rows, self.ids, self.k = queries, query_ids, rows, ids, k
        self.scores = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = floor
        self.exact = self._largest() < 2**53

    def _largest(self) -> float:
        most = [float(np.abs(x).max()) if x.size else 0.0 for x in (self.queries, self.rows)]
        return most[0] * most[1] * max(1, self.rows.shape[1])

    def worst(self, q: Node) -> float:
        """The lowest score that could still enter for a query of the group."""
        return float(np.maximum(self.scores[q.rows, -1].astype(float), self.floor[q.rows]).min())

    def leaf(self, q: Node, c: Node) -> None:
        a, b = self.queries[q.rows], self.rows[c.rows]
        new = a @ b.T if self.exact else a.astype(np.int64) @ b.astype(np.int64).T
        # Most products are below the kth score so far, or below the query's first bound.
        enters = (new >= self.scores[q.rows, -1:]) & (new >= self.floor[q.rows, None])
        enters &= self.ids[c.rows] != self.query_ids[q.rows, None]
        some, rows = enters.any(axis=1), enters.any(axis=0)
        if not some.any():
            return
        at, enters = q.rows[some], enters[np.ix_(some, rows)]
        new = np.where(enters, new[np.ix_(some, rows)].astype(np.int64), np.iinfo(np.int64).min)
        ids = np.where(enters, self.ids[c.rows[rows]], np.iinfo(np.int64).max)
        scores = np.concatenate([self.scores[at], new], axis=1)
        ids = np.concatenate([self.found[at], ids], axis=1)
        order = np.lexsort((ids, -scores.astype(float) if self.exact else ~scores))[:, : self.k]
        self.scores[at] = np.take_along_axis(scores, order, axis=1)
        self.found[at] = np.take_along_axis(ids, order, axis=1)

    def run(self, q: Node, c: Node) -> None:
        work = [(best_product(q, c), q, c)]
        while work:
            bound, q, c = work.pop()
            if bound < self.worst(q):
                continue
            if not q.kids and not c.kids:
                self.leaf(q, c)
                continue
            split_q = q.kids and (not c.kids or q.radius > c.radius)
            pairs = [(x, c) for x in q.kids] if split_q else [(q, x) for x in c.kids]
            scored = [(best_product(x, y), x, y) for x, y in pairs]
            work += sorted(scored, key=lambda p: p[0])  # the best is taken first


def vectors(df: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Valid rows: id and integer components."""
    x = F.col(column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(256.0)).cast("long"))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(x).alias("dim")
    )


_PLACED = "id long, v array<long>, dim int, cluster int, far double, floor double"
_PLACED_ARROW = arrow_schema(
    id=pa.int64(), v=pa.list_(pa.int64()), dim=pa.int32(), cluster=pa.int32(), far=pa.float64(), floor=pa.float64()
)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _placed(rows: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Nearest pivot and distance of every row, and its kth score among the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                ids, points = np.asarray(part.column("id")), _matrix(part.column("v"), dim)
                n = len(ids)
                cluster, far, floor = np.full(n, -1, np.int32), np.full(n, np.inf), np.full(n, -np.inf)
                if dim in pivots:
                    pivot_ids, centers = pivots[dim]
                    square = (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)
                    cluster = square.argmin(axis=1).astype(np.int32)
                    far = np.sqrt(((points - centers[cluster]) ** 2).sum(axis=1))
                    scores = np.where(ids[:, None] == pivot_ids, -np.inf, points @ centers.T)
                    if len(pivot_ids) >= k:
                        floor = np.partition(scores, -k, axis=1)[:, -k]
                        floor = floor - 1e-9 * np.abs(floor)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("v"), part.column("dim"), pa.array(cluster), pa.array(far), pa.array(floor)],
                    schema=_PLACED_ARROW,
                )

    return rows.mapInArrow(run, _PLACED)


_HITS = "query_id long, query_v array<long>, id long, score long"
_HITS_ARROW = arrow_schema(query_id=pa.int64(), query_v=pa.list_(pa.int64()), id=pa.int64(), score=pa.int64())


def _search_block(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _HITS_ARROW.empty_table()
        dim = queries.column("dim")[0].as_py()
        q, c = (_matrix(t.column("v").combine_chunks(), dim) for t in (queries, rows))
        query_ids, ids = (np.asarray(t.column("id")) for t in (queries, rows))
        search = Search(q, query_ids, c, ids, k, np.asarray(queries.column("floor")))
        search.run(cover_tree(q, np.arange(len(q))), cover_tree(c, np.argsort(ids, kind="stable")))
        at, place = np.nonzero(search.found != np.iinfo(np.int64).max)
        return pa.table(
            [
                pa.array(query_ids[at]),
                queries.column("v").combine_chunks().take(pa.array(at)),
                pa.array(search.found[at, place]),
                pa.array(search.scores[at, place]),
            ],
            schema=_HITS_ARROW,
        )

    return run


def top_products(rows: DataFrame, is_query: Column, k: int = 5, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` best rows of every query: query_id, rank, vec_id, score.

    ``rows`` comes from ``vectors``; ``is_query`` is a condition on its columns.
    """
    spark = rows.sparkSession
    rows = rows.distinct()
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect():  # a bounded sample
        if all(r["id"] != x["id"] for x in sample.get(r["dim"], [])):
            sample.setdefault(r["dim"], []).append(r)
    centers = {d: (np.array([r["id"] for r in rs]), np.array([r["v"] for r in rs], dtype=float).reshape(len(rs), d)) for d, rs in sample.items()}
    placed = written(_placed(rows, centers, k), "placed")
    query_rows = placed.where(is_query)
    groups = ["dim", "cluster"]
    # A row per cluster: at most `pivots` and one per vector length.
    covers = placed.groupBy(*groups).agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    asked = query_rows.groupBy(*groups).agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("floor").alias("floor")).collect()

    def node(r) -> Node:
        known = r["cluster"] >= 0
        return Node(centers[r["dim"]][1][r["cluster"]] if known else np.zeros(0), r["far"] if known else np.inf, np.zeros(0), [])

    blocks, block, held = [], 0, 0
    for r in sorted(asked, key=lambda r: (r["dim"], r["cluster"])):
        # Small neighbouring groups share a block; a large one is split by hash.
        if held + r["n"] > block_rows or (blocks and blocks[-1][0] != r["dim"]):
            block, held = block + 1, 0
        parts = -(-r["n"] // block_rows)
        blocks.append((r["dim"], r["cluster"], block, parts))
        block, held = block + parts - 1, (held if parts == 1 else block_rows) + r["n"]
    places = {(d, c): (b, p) for d, c, b, p in blocks}
    pairs = []
    for a in asked:
        for b in covers:
            if a["dim"] != b["dim"]:
                continue
            apart = a["cluster"] < 0 or b["cluster"] < 0 or best_product(node(a), node(b)) >= a["floor"]
            if apart:
                pairs.append((a["dim"], a["cluster"], b["cluster"], *places[a["dim"], a["cluster"]], -(-b["n"] // block_rows)))
    # At most (pivots + lengths) squared rows.
    meets = F.broadcast(spark.createDataFrame(pairs, "dim int, cluster int, other int, block int, parts int, cuts int"))
    own_part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    left = (
        query_rows.join(meets, groups)
        .withColumn("block", F.col("block") + own_part)
        .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(*[F.col(c).alias(c) for c in ("id", "v", "dim", "floor")], F.col("other").alias("cluster"), F.col("block").alias("block"), F.col("cut").alias("cut"))
    )
    reach = sorted({(d, o, b + i, cuts) for d, _, o, b, parts, cuts in pairs for i in range(parts)})
    reached = F.broadcast(spark.createDataFrame(reach, "dim int, cluster int, block int, cuts int"))
    right = (
        placed.join(reached, groups)
        .withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        .select(*[F.col(c).alias(c) for c in ("id", "v", "dim", "cluster", "block", "cut")])
    )
    keys = ["dim", "cluster", "block", "cut"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_block(k), _HITS)
    best = Window.partitionBy("query_id", "query_v").orderBy(F.desc("score"), "id")
    # An id whose rows differ may be found twice; each row counts.
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
    )
