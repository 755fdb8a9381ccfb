"""A Merkle manifest of a dataset: digests, proofs and their check for every row.

Every row is a leaf. Per source, leaves ascend by id and every ``FAN`` consecutive nodes
become one, level by level, up to the source's subroot; subroots in source order become
the root in the same way. A row's proof is its siblings on the way up.

Three steps carry this over any number of rows:

* Rows are numbered within their source in two levels (places inside the parts of a range
  partitioning, plus the sizes of earlier parts), so no source meets in one task.
* ``FAN ** SUPER`` consecutive leaves are a superblock. Its digest is reduced in one task;
  the levels above are built from superblock digests alone, one small join per level, and
  every superblock gets the outer siblings of its path.
* Leaves and outer nodes are cogrouped by superblock: each task finishes the local levels,
  joins local and outer siblings to proofs and folds leaves back to the root.

Defined cases: a null value is encoded differently from an empty one; rows without an id
come first in their source, rows that repeat an id are ordered by their digests (identical
rows are interchangeable); null sources come first; a row without an id is never
tampered with; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from airspark.session import written

FAN = 16
#: Levels that one task reduces: a superblock holds FAN ** SUPER leaves.
SUPER = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST_CHARS = 64


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: every value as its byte count and itself, so that none runs into the next."""

    def encoded(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def placed(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Add ``_i``, the place of a row among those of its key from 0, and ``_n``, their number.

    Rows are range partitioned, so a key with very many rows lies in several parts.
    """
    parts = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), label)
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"))
    # As many rows per key as parts hold it.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_n"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (
        parts.withColumn("_in", inside).join(sizes, [*keys, "_part"]).withColumn("_i", F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")
    )


def _above(count: Column) -> Column:
    """How many parents that many nodes have."""
    return F.floor((count + FAN - 1) / FAN).cast("long")


def tower(nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Build the levels above ``nodes`` (_s, _i, _n, digest): tops and paths.

    Tops are ``_s, top``. Paths are ``_s, _i, path``: per level, from below, the joined
    digests of the siblings to the left and to the right. Each level is FAN times smaller
    than the one below and cut off as a written table.
    """
    levels, tops = [], []
    while True:
        tops.append(nodes.where(F.col("_n") == 1).select("_s", F.col("digest").alias("top")))
        runs = nodes.where(F.col("_n") > 1).groupBy("_s", F.floor(F.col("_i") / FAN).alias("_i"), _above(F.col("_n")).alias("_n"))
        kids = F.array_sort(F.collect_list(F.struct("_i", "digest")))["digest"]
        up = written(runs.agg(kids.alias("kids")).withColumn("digest", F.sha2(F.array_join("kids", ""), 256)), label)
        if up.isEmpty():
            break
        levels.append(up)
        nodes = up.select("_s", "_i", "_n", "digest")
    step = "array<struct<left:string,right:string>>"
    paths = None
    for level in reversed(levels):
        inherited = F.array().cast(step)
        if paths is not None:
            level = level.join(paths, ["_s", "_i"], "left")
            inherited = F.coalesce("path", inherited)
        own = F.array(
            F.struct(
                F.array_join(F.slice("kids", F.lit(1), F.col("_k")), "").alias("left"),
                F.array_join(F.slice("kids", F.col("_k") + 2, F.lit(FAN)), "").alias("right"),
            )
        )
        spread = level.select("_s", F.col("_i").alias("_p"), "kids", inherited.alias("above"), F.posexplode("kids").alias("_k", "_d"))
        lower = spread.select("_s", (F.col("_p") * FAN + F.col("_k")).alias("_i"), F.concat(own, "above").alias("path"))
        paths = lower
    if paths is None:
        paths = nodes.select("_s", "_i", F.array().cast(step).alias("path")).limit(0)
    return _union(tops), paths


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local_levels(count: int, fan: int = FAN, most: int = SUPER) -> int:
    """Levels between the leaves of a source and its superblocks (or its subroot, if nearer)."""
    levels = 0
    while levels < most and count > fan**levels:
        levels += 1
    return levels


def reduced(digests: list[str], levels: int, fan: int = FAN) -> list[list[str]]:
    """The joined digests of every run, level by level, and at last the one node above all."""
    runs = []
    for _ in range(levels):
        runs.append(["".join(digests[a : a + fan]) for a in range(0, len(digests), fan)])
        digests = [_hash(r) for r in runs[-1]]
    return [*runs, digests]


def _super_digest(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("_i")
    levels = local_levels(int(block["_n"].iloc[0]))
    top = reduced(block["leaf"].tolist(), levels)[-1][0]
    return pd.DataFrame({"_s": block["_s"].iloc[:1], "_b": block["_b"].iloc[:1], "_n": block["_n"].iloc[:1], "digest": [top]})


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _finish(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Local reduction, proofs and folds of one superblock."""
    block = block.sort_values("_i")
    leaves = block["leaf"].tolist()
    runs = reduced(leaves, local_levels(int(block["_n"].iloc[0])))[:-1]
    row = outer.iloc[0]
    beyond = [(s["left"], s["right"]) for s in [*row["path"], *row["source_path"]]]
    tail = "".join(a + b for a, b in beyond).encode()
    proofs, folds = [], []
    for at, (leaf, changed) in enumerate(zip(leaves, block["changed"].tolist())):
        siblings = []
        for run in runs:
            at, place = divmod(at, FAN)
            text, cut = run[at], place * DIGEST_CHARS
            siblings.append((text[:cut], text[cut + DIGEST_CHARS :]))
        proof = hashlib.sha256("".join(a + b for a, b in siblings).encode())
        proof.update(tail)
        proofs.append(proof.hexdigest())
        node = leaf if changed is None else changed
        for left, right in (*siblings, *beyond):
            node = _hash(left + node + right)
        folds.append(node)
    out = pd.DataFrame({"doc_id": block["doc_id"], "leaf": leaves})
    out["subroot"], out["root"] = row["subroot"], row["root"]
    out["proof_sha256"], out["folded_root"] = proofs, folds
    out["verified"] = out["folded_root"] == row["root"]
    return out


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, subroot, root and proof digest of every row, and whether it still folds to the root.

    ``changes`` gives new values of some fields for the rows that ``tampered`` picks: what
    a reader would find in their place. Only the fold sees them.
    """
    changed = F.lit(None).cast("string")
    if changes:
        later = [changes.get(f, F.col(f)) for f in FIELDS]
        changed = F.when(tampered, leaf_digest(later))
    # One character before the name keeps null sources, as empty keys, ahead of all others.
    source = F.coalesce(F.concat(F.lit("-"), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(source.alias("_s"), F.col("doc_id").cast("long"), leaf_digest([F.col(f) for f in FIELDS]).alias("leaf"), changed.alias("changed"))
    size = FAN**SUPER
    leaves = written(placed(leaves, ["_s"], ["doc_id", "leaf"], "leaf-parts").withColumn("_b", F.floor(F.col("_i") / size)), "leaves")
    blocks = leaves.select("_s", "_b", "_i", "_n", "leaf").groupBy("_s", "_b").applyInPandas(_super_digest, "_s string, _b long, _n long, digest string")
    blocks = written(blocks.select("_s", F.col("_b").alias("_i"), F.floor((F.col("_n") + size - 1) / size).alias("_n"), "digest"), "superblocks")
    subroots, paths = tower(blocks, "source-level")
    subroots = written(subroots, "subroots")
    sources = placed(subroots.select(F.col("_s").alias("_name"), F.col("top").alias("digest"), F.lit("").alias("_s")), ["_s"], ["_name"], "source-parts")
    sources = written(sources, "sources")
    roots, source_paths = tower(sources.select("_s", "_i", "_n", "digest"), "root-level")
    named = sources.select(F.col("_name"), "_i", F.col("digest").alias("subroot")).join(
        source_paths.select("_i", F.col("path").alias("source_path")), "_i", "left"
    )
    root = roots.select("top").first()
    step = "array<struct<left:string,right:string>>"
    outer = (
        blocks.select("_s", "_i")
        .join(paths, ["_s", "_i"], "left")
        .join(named.select(F.col("_name").alias("_s"), "subroot", "source_path"), "_s")
        .select(
            "_s",
            F.col("_i").alias("_b"),
            F.coalesce("path", F.array().cast(step)).alias("path"),
            F.coalesce("source_path", F.array().cast(step)).alias("source_path"),
            "subroot",
            F.lit(root["top"] if root else None).cast("string").alias("root"),
        )
    )
    return leaves.groupBy("_s", "_b").cogroup(outer.groupBy("_s", "_b")).applyInPandas(_finish, RESULT)


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest with the texts of every fifth row, by the checksum of its id, turned to lower case."""
    fifth = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return merkle_manifest(docs, fifth, {"text": lower_ascii(F.col("text"))})
