"""Connected components of an edge table, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airspark.session import written


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for every node but the roots.

    ``edges`` has comparable columns a and b; null ends and loops are ignored. Alternates
    two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller ones. The number of rounds grows with the logarithm
    of the longest path. Minima are taken before the shuffle, and the joins give each
    node one partner row, so a node with very many neighbours may be split. Each
    round is a written table.
    """
    rows = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges"
    )
    seen = None
    while True:
        found = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if seen == (found["n"], found["x"]) or not found["n"]:
            return rows.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = (found["n"], found["x"])
        # Larger neighbours of a node go to the smallest among the node and its neighbours.
        lowest = rows.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("m"))
        large = (
            rows.join(lowest, "u", "left").select("v", F.coalesce("m", "u").alias("u")).distinct()
        )
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(
            F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")
        )
        rows = written(small.select("e.v", "e.u").where("v <> u").distinct(), "edges")
