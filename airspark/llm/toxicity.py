"""Toxicity with a small convolutional network trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first bytes, so
inflected forms of a stem share most of it. Filters of several widths run over all
words of a text; the largest two values of each filter are pooled and go to a logistic
output. The network is fitted on three quarters of all labelled rows: these are dealt to
shards, in every epoch each shard trains its own copy in a task, and the copies' changes are
averaged (those of a bucket over the shards that changed it). Its output is scaled on the
other quarter, and one threshold per language is calibrated on it. Language is never an
input of a score.

Scoring is one pass over whole texts in tasks; the parameters have a fixed size, and so has
what an epoch sends to the driver. Changes are summed as integers, so that the order in
which tasks end does not matter.

Defined cases: null and empty texts get the score of a text without words; labels that
are null are left out, of contradicting labels of an id the toxic one counts; without
labelled rows of both classes every score is the share of toxic rows (0 without rows);
rows that repeat an id are scored each on its own, rows without an id too (of labelled
rows that repeat an id the first text is learned from); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from airspark.llm.common import text_slices, word_parts
from airspark.session import shuffles_dropped, written

SCORE_AT = 0.7
PREFIXES = (4, 5, 6, 7)
BUCKETS = 1 << 17
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: One of so many labelled rows is kept out of the fit, for scale and thresholds.
SPARE = 4
#: Bytes of texts that a task trains on at once, and words of a step.
TRAIN_BYTES = 1 << 22
STEP_WORDS = 1 << 18
#: Changes of parameters are summed in units of 1 / UNIT; those of one shard and epoch are far below MOST / UNIT = 128.
UNIT = float(1 << 24)
MOST = (1 << 31) - 1
#: Remainders of labelled ids that are named to all tasks, so that most other texts are left out before the shuffle; a fixed bound.
NAMED = 1 << 20
#: Units of the sums that scale the output, over all rows.
SCALE_UNIT = 1 << 24
GRID = np.round(np.arange(0.3, 0.96, 0.05), 2)


@dataclass(frozen=True)
class FitSettings:
    """Labelled rows of a shard, epochs over all of them, rows of a step and its size."""

    shard_rows: int = 5000
    epochs: int = 6
    batch: int = 32
    rate: float = 0.1
    seed: int = 7


@dataclass
class Network:
    """Parameters; ``seen`` marks the buckets that training met, all others count as zero."""

    tables: np.ndarray
    filters: list[np.ndarray]
    shifts: np.ndarray
    output: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (components x words) and where the words of each text begin."""
    parts, at = word_parts(texts, letters=True, prefixes=PREFIXES)
    return np.stack([(p & np.uint64(BUCKETS - 1)).astype(np.int32) for p in parts]), at


def _vectors(net: Network, ids: np.ndarray) -> np.ndarray:
    x = net.tables[0][ids[0]]
    for table, own in zip(net.tables[1:], ids[1:]):
        x += table[own]
    return x


def _conv(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values of filters at all places; beyond the last word the vectors are zero."""
    z = x @ w[0]
    for j in range(1, len(w)):
        z[:-j] += x[j:] @ w[j]
    return z


def _forward(net: Network, x: np.ndarray, at: np.ndarray, places: bool = False):
    """Pooled values (texts x filters of all widths x 2), and the places they come from.

    Texts must have words. Filters may not reach into the next text, so each text is
    followed by rows of zeros in ``x``.
    """
    pooled, where = [], []
    ends = np.diff(np.append(at, len(x)))
    for w in net.filters:
        z = _conv(x, w)
        for rank in range(2):
            best = np.maximum.reduceat(z, at, axis=0)
            pooled.append(best)
            if places or rank == 0:
                hit = z == np.repeat(best, ends, axis=0)
                first = np.where(hit, np.arange(len(z))[:, None], len(z))
                place = np.minimum.reduceat(first, at, axis=0)
                where.append(place)
                if rank == 0:
                    z[place, np.arange(z.shape[1])] = -1e3
    return np.stack(pooled, axis=1), where


def _padded(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors with zero rows after each text (at least two), the new begins, and the old rows' places."""
    sizes = np.diff(at)
    gap = max(WIDTHS)
    begins = np.cumsum(sizes + gap) - sizes - gap
    to = np.arange(len(x)) + np.repeat(begins - at[:-1], sizes)
    out = np.zeros((len(x) + gap * len(sizes), x.shape[1]), np.float32)
    out[to] = x
    return out, begins, to


def logits(net: Network, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    x, begins, _ = _padded(_vectors(net, ids), at)
    if not len(begins):
        return np.empty(0)
    pooled, _ = _forward(net, x, begins)
    hidden = np.maximum(pooled + net.shifts, 0.0)
    return np.einsum("npf,pf->n", hidden, net.output) + net.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fresh(s: FitSettings) -> tuple[Network, dict]:
    """A network before training, and the sums of squares that Adagrad starts from."""
    rng = np.random.default_rng(s.seed)
    pools = 2 * len(WIDTHS)
    net = Network(
        (0.1 * rng.standard_normal((1 + len(PREFIXES), BUCKETS, SIZE))).astype(np.float32),
        [(rng.standard_normal((k, SIZE, FILTERS)) * 0.5).astype(np.float32) for k in WIDTHS],
        np.zeros((pools, FILTERS), np.float32),
        (rng.standard_normal((pools, FILTERS)) * 0.3).astype(np.float32),
        0.0,
    )
    squares = {"tables": np.full(net.tables.shape[:2], 1e-3, np.float32), "filters": [np.full(w.shape, 1e-2, np.float32) for w in net.filters]}
    squares |= {"shifts": np.full(net.shifts.shape, 1e-2, np.float32), "output": np.full(net.output.shape, 1e-2, np.float32), "bias": 1e-2}
    return net, squares


def _steps(order: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Cut texts into steps of at most ``most`` texts and, but for a longer text alone, ``STEP_WORDS`` words."""
    start = words = 0
    for i, n in enumerate(sizes[order].tolist()):
        if i > start and (i - start == most or words + n > STEP_WORDS):
            yield order[start:i]
            start, words = i, 0
        words += n
    if start < len(order):
        yield order[start:]


def train(net: Network, squares: dict, ids: np.ndarray, at: np.ndarray, toxic: np.ndarray, share: float, epoch: int, s: FitSettings) -> None:
    """One epoch of Adagrad on the logistic loss, in place; classes weigh the same.

    ``share`` is the toxic share of all rows of the fit.
    """
    rate = s.rate / (1 + epoch)
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    full = np.flatnonzero(np.diff(at) > 0)
    for docs in _steps(np.random.default_rng([s.seed, epoch]).permutation(full), np.diff(at), s.batch):
        sizes = at[docs + 1] - at[docs]
        begin = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) + np.repeat(at[docs] - begin, sizes)
        own = ids[:, rows]
        x, begins, to = _padded(_vectors(net, own), np.append(begin, sizes.sum()))
        pooled, where = _forward(net, x, begins, places=True)
        on = pooled + net.shifts
        hidden = np.maximum(on, 0.0)
        y = sigmoid(np.einsum("npf,pf->n", hidden, net.output) + net.bias)
        miss = (weight[docs] * (y - toxic[docs]) / len(docs)).astype(np.float32)
        g_out = np.einsum("n,npf->pf", miss, hidden) + 1e-4 * net.output
        g_pool = miss[:, None, None] * net.output * (on > 0)
        g_x = np.zeros_like(x)
        for k, w in enumerate(net.filters):
            g_w = 1e-4 * w
            for rank in range(2):
                place, g = where[2 * k + rank], g_pool[:, 2 * k + rank]
                for j in range(len(w)):
                    spot = np.minimum(place + j, len(x) - 1)
                    g_w[j] += np.einsum("nf,nfd->df", g, x[spot])
                    np.add.at(g_x, spot.ravel(), (g[:, :, None] * w[j].T).reshape(-1, SIZE))
            squares["filters"][k] += g_w**2
            net.filters[k] = w - rate * g_w / np.sqrt(squares["filters"][k])
        for name, g in (("output", g_out), ("shifts", g_pool.sum(axis=0))):
            squares[name] += g**2
            setattr(net, name, getattr(net, name) - rate * g / np.sqrt(squares[name]))
        squares["bias"] += float(miss.sum()) ** 2
        net.bias -= rate * float(miss.sum()) / np.sqrt(squares["bias"])
        g_rows = g_x[to]
        touched = np.flatnonzero(np.abs(g_rows).sum(axis=1))
        for c, table in enumerate(net.tables):
            spot, inverse = np.unique(own[c][touched], return_inverse=True)
            g = np.zeros((len(spot), SIZE), np.float32)
            np.add.at(g, inverse, g_rows[touched])
            squares["tables"][c][spot] += (g**2).mean(axis=1)
            table[spot] -= rate * g / np.sqrt(squares["tables"][c][spot])[:, None]


def _small(net: Network, squares: dict) -> np.ndarray:
    """All parameters but the tables, and their sums of squares, in rows of ``SIZE``."""
    parts = [*net.filters, net.shifts, net.output, net.bias, *squares["filters"], squares["shifts"], squares["output"], squares["bias"]]
    flat = np.concatenate([np.ravel(p).astype(np.float64) for p in parts])
    return np.append(flat, np.zeros(-len(flat) % SIZE)).reshape(-1, SIZE)


def _set_small(net: Network, squares: dict, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0

    def take(old: np.ndarray) -> np.ndarray:
        nonlocal at
        at += old.size
        return flat[at - old.size : at].reshape(old.shape).astype(np.float32)

    def some(weights: list[np.ndarray], shifts: np.ndarray, output: np.ndarray) -> tuple:
        found = [take(w) for w in weights], take(shifts), take(output), float(flat[at])
        return found

    net.filters, net.shifts, net.output, net.bias = some(net.filters, net.shifts, net.output)
    at += 1
    squares["filters"], squares["shifts"], squares["output"], squares["bias"] = some(squares["filters"], squares["shifts"], squares["output"])


def _copied(net: Network, squares: dict) -> tuple[Network, dict]:
    own = Network(net.tables.copy(), list(net.filters), net.shifts, net.output, net.bias)
    return own, {k: [x.copy() for x in v] if isinstance(v, list) else v.copy() if isinstance(v, np.ndarray) else v for k, v in squares.items()}


_VALUES = [f"d{i}" for i in range(SIZE)]
#: Changes that a shard sends: the bucket's number (below 0: a row of the other parameters, then words of the marks of
#: buckets that were met), what its sum of squares and its parameters grew by, and the marks.
_CHANGES = "key int, q int, " + ", ".join(f"{c} int" for c in _VALUES) + ", seen long"
_CHANGES_ARROW = pa.schema([(c, pa.int32()) for c in ("key", "q", *_VALUES)] + [("seen", pa.int64())])


def _epoch(rows: DataFrame, net: Network, squares: dict, share: float, epoch: int, s: FitSettings) -> np.ndarray:
    """Train a copy in every partition and add the mean changes to the network; after the last epoch returns marks of the
    buckets that were met."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((net, squares))  # fixed size
    small, last = len(_small(net, squares)), epoch == s.epochs - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, old_squares = shared.value
        own, own_squares = _copied(old, old_squares)
        seen, any_rows = np.zeros(own.tables.shape[:2], bool), False
        for batch in batches:
            for part in text_slices(batch, limit=TRAIN_BYTES):
                any_rows = True
                ids, at = buckets_of(part.column("text"))
                for c, found in enumerate(ids):
                    seen[c, found] = True
                train(own, own_squares, ids, at, np.asarray(part.column("toxic")).astype(np.float32), share, epoch, s)
        if not any_rows:
            return
        keys = np.flatnonzero((own_squares["tables"] != old_squares["tables"]).ravel())
        marks = np.packbits(seen.ravel()).view(np.int64) if last else np.empty(0, np.int64)
        grown = np.concatenate([
            own.tables.reshape(-1, SIZE)[keys].astype(np.float64) - old.tables.reshape(-1, SIZE)[keys],
            _small(own, own_squares) - _small(old, old_squares),
            np.zeros((len(marks), SIZE)),
        ])
        q = own_squares["tables"].ravel()[keys].astype(np.float64) - old_squares["tables"].ravel()[keys]
        rest = small + len(marks)
        units = np.clip(np.rint(np.column_stack([np.append(q, np.zeros(rest)), grown]) * UNIT), -MOST, MOST).astype(np.int32)
        columns = [np.append(keys, -1 - np.arange(rest)).astype(np.int32), *units.T, np.append(np.zeros(len(keys) + small, np.int64), marks)]
        for i in range(0, len(grown), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000]) for c in columns], schema=_CHANGES_ARROW)

    sent = rows.select("text", "toxic").mapInArrow(run, _CHANGES)
    mean = lambda c: (F.sum(c) / F.count("*") / UNIT).alias(c)
    # A row for every bucket of the tables at most.
    with shuffles_dropped(spark):
        found = sent.groupBy("key").agg(mean("q"), *[mean(c) for c in _VALUES], F.bit_or("seen").alias("seen")).toArrow()
    shared.destroy()
    key = found.column("key").to_numpy()
    grown = np.stack([found.column(c).to_numpy() for c in _VALUES], axis=1)
    of_table, of_small, of_marks = key >= 0, (key < 0) & (key >= -small), key < -small
    net.tables.reshape(-1, SIZE)[key[of_table]] += grown[of_table].astype(np.float32)
    squares["tables"].reshape(-1)[key[of_table]] += found.column("q").to_numpy()[of_table].astype(np.float32)
    rows_of = _small(net, squares)
    rows_of[-1 - key[of_small]] += grown[of_small]
    _set_small(net, squares, rows_of)
    marks = np.zeros(net.tables.shape[0] * BUCKETS // 64, np.int64)
    marks[-1 - small - key[of_marks]] = found.column("seen").to_numpy()[of_marks]
    return np.unpackbits(marks.view(np.uint8)).view(bool).reshape(net.tables.shape[:2])


def fit_scale(known: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through ``raw`` for ``toxic``, by Newton's method with a small prior."""
    a, b = 1.0, 0.0
    x, miss = F.col("raw"), F.col("p") - F.col("toxic")
    v = F.col("p") * (1 - F.col("p"))
    sums = [F.sum(F.round(e * SCALE_UNIT).cast("long")) for e in (miss * x, miss, v * x * x, v * x, v)]
    for _ in range(rounds):
        found = known.withColumn("p", _curve(x, a, b)).agg(*sums).first()
        g0, g1, h00, h01, h11 = [(n or 0) / SCALE_UNIT for n in found]
        g = np.array([g0 + 1e-2 * (a - 1), g1 + 1e-2 * b])
        step = np.linalg.solve(np.array([[h00 + 1e-2, h01], [h01, h11 + 1e-2]]), g)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = max(1e-3, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _curve(x: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x * a + b))))


def best_threshold(hits: np.ndarray, above: np.ndarray, toxic: int) -> float:
    """The threshold of the best F1 from the toxic rows and all rows at or above each of ``GRID``;
    between equally good ones the nearest to ``SCORE_AT``."""
    f1 = 2 * hits / (above + toxic)
    best = GRID[f1 >= f1.max() - 1e-9]
    return float(best[np.abs(best - SCORE_AT).argmin()])


def thresholds(known: DataFrame, scale: tuple[float, float], least: int = 50) -> dict[str, float]:
    """The best threshold by language. Languages with few rows, or no toxic ones, keep ``SCORE_AT``."""
    above = [F.col("score") >= float(t) for t in GRID]
    counts = (
        known.withColumn("score", _curve(F.col("raw"), *scale)).groupBy("lang")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.array(*[F.sum(F.when(x, F.col("toxic")).otherwise(0)) for x in above]).alias("hits"), F.array(*[F.count_if(x) for x in above]).alias("above"))
        .where((F.col("n") >= least) & (F.col("toxic") > 0))
    )
    return {r["lang"]: best_threshold(np.array(r["hits"], float), np.array(r["above"], float), r["toxic"]) for r in counts.orderBy("lang").collect()}


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: FitSettings = FitSettings()) -> Network | float:
    """A network, or a constant score where labels do not allow one."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )
    known = known.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(SPARE)) != 0)  # the others are kept for calibration
    shards = -(-known.count() // s.shard_rows)
    if not shards:
        return 0.0
    rows = labelled_texts(docs, known, shards, s).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {r["fit"]: r for r in rows.groupBy("fit").agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("toxic")).collect()}
        if True not in counts:
            return 0.0
        share = counts[True]["toxic"] / counts[True]["n"]
        if share in (0, 1):
            return float(share)
        net, squares = fresh(s)
        some = rows.where("fit")
        for epoch in range(s.epochs):
            seen = _epoch(some, net, squares, share, epoch, s)
        net.tables[~seen] = 0.0  # nothing is known of buckets that training never met
        raw = written(_logits(rows.where("not fit") if False in counts else some, net), "logits")
    finally:
        rows.unpersist()
    net.scale = fit_scale(raw)
    net.thresholds = thresholds(raw, net.scale)
    return net


def labelled_texts(docs: DataFrame, known: DataFrame, shards: int, s: FitSettings) -> DataFrame:
    """doc_id, text, lang, toxic and fit of all labelled documents, a shard in each partition.

    Labels and texts are dealt together and meet side by side, so that texts are shuffled once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lower(F.col("text").cast("string")), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    name = F.pmod("doc_id", F.lit(NAMED)).cast("int").alias("_name")
    named = F.broadcast(known.select(name).distinct())  # at most NAMED rows
    texts = texts.where(~held_out(F.col("doc_id"))).withColumn("_name", name).join(named, "_name", "left_semi").drop("_name")
    both = known.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "toxic", "fit").unionByName(texts, allowMissingColumns=True)
    # One shard is one partition; all of an id are in the same one, its label first.
    dealt = both.repartitionById(shards, F.pmod(F.xxhash64("doc_id", F.lit(s.seed + 1)), F.lit(shards)).cast("int"))
    dealt = dealt.sortWithinPartitions(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id", F.asc_nulls_first("text"), "lang")
    return dealt.mapInArrow(_first_of_each, "doc_id long, text string, lang string, toxic int, fit boolean")


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows side by side with the same id, the first text, with the label before it; none without a label."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if last is None else [last, batch])
        ids = rows.column("doc_id").to_numpy()
        label = rows.column("text").is_null().to_numpy()
        at = np.flatnonzero((ids[1:] == ids[:-1]) & label[:-1] & ~label[1:])
        texts, labels = rows.take(at + 1), rows.take(at)
        yield from pa.table([*texts.select(["doc_id", "text", "lang"]).columns, *labels.select(["toxic", "fit"]).columns], names=batch.schema.names).combine_chunks().to_batches()
        last = batch.slice(batch.num_rows - 1)


def _logits(rows: DataFrame, net: Network) -> DataFrame:
    """lang, toxic and raw, the output before it is scaled."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                raw = pa.array(score_texts(shared.value, part.column("text"), scaled=False).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), raw], names=["lang", "toxic", "raw"])

    return rows.select("text", "lang", "toxic").mapInArrow(run, "lang string, toxic int, raw double")


def score_texts(net: Network, texts: pa.Array, scaled: bool = True) -> np.ndarray:
    ids, at = buckets_of(texts)
    empty = np.full(len(texts), float(net.bias))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        empty[full] = logits(net, ids, np.append(at[full], at[-1]))
    return sigmoid(net.scale[0] * empty + net.scale[1]) if scaled else empty


def score_documents(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least ``SCORE_AT``) and
    flagged (score at least the threshold of the document's language)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    if isinstance(net, float):
        scored, thresholds = rows.select("doc_id", "lang", F.lit(net).alias("score")), {}
    else:
        shared, thresholds = docs.sparkSession.sparkContext.broadcast(net), net.thresholds  # fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch):
                    score = pa.array(score_texts(shared.value, part.column("text")))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), score], names=["doc_id", "lang", "score"])

        scored = rows.mapInArrow(run, "doc_id long, lang string, score double")
    limit = F.lit(SCORE_AT)
    for lang, t in thresholds.items():
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= SCORE_AT).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"),
    )


def score_all(docs: DataFrame, labels: DataFrame, settings: FitSettings = FitSettings()) -> DataFrame:
    return score_documents(docs, fit(docs, labels, settings))


def without_toxic(docs: DataFrame, labels: DataFrame, settings: FitSettings = FitSettings()) -> DataFrame:
    """The documents that are not flagged; scored and filtered in one pass, so that rows
    that share an id or have none are judged each on its own."""
    net = fit(docs, labels, settings)
    if isinstance(net, float):
        return docs  # nothing was learned, so nothing is rejected
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = shared.value.thresholds
        for batch in batches:
            for part in text_slices(batch):
                low = pa.array([(t or "").lower() for t in part.column(text).to_pylist()], pa.large_string())
                at = np.array([limits.get(x or "", SCORE_AT) for x in part.column(lang).to_pylist()])
                yield part.filter(pa.array(score_texts(shared.value, low) < at))

    return docs.mapInArrow(run, docs.schema)
