"""Packing: documents become token pieces, pieces become sequences of bounded length.

Cutting-stock column generation. Every document is cut at multiples of the
capacity, so all pieces but its last fill a sequence alone. The histogram of the
last pieces (at most ``capacity`` rows, whatever the input) gives a linear program
over patterns, whose columns a knapsack dynamic program prices. Rounded patterns
become ranges of ranks: piece number r of a length class knows its sequence from r.

Token ids never leave the task that makes them; what is shuffled are rows of a few
numbers per piece.

Defined cases: a null text is an empty one and gives the end id alone; null and
repeated ids are packed like any other row; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from airspark.llm.common import arrow_schema, text_slices
from airspark.session import written

CAPACITY = 2048
END_ID = 1
#: Lengths are rounded up to this many tokens in the linear program.
GRAIN = 8
#: Rows that a task ranks at once.
RANK_ROWS = 50_000
#: A character that stands between words while they are encoded together.
MARK = "\x01"
#: Words whose ids a task remembers.
CACHED_WORDS = 400_000
#: Bytes of text whose words a task looks up at once.
TOKEN_BYTES = 1 << 23

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECE_ARROW = arrow_schema(doc_id=pa.int64(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), doc_tokens=pa.int64())


#: The rules under which ``detached`` changes no id: how text is normalised, and the pattern it is cut at.
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A letter or digit, then ASCII punctuation that ends a word.
_TAIL = r"([0-9a-zß-öø-ÿ])([!-/:-@\[-`{-~]+)(\s|$)"


def cuts_punctuation(rules: dict) -> bool:
    """Whether a tokenizer lowers letters and encodes letters and punctuation apart."""
    first, *rest = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    after = [{k: x.get(k) for k in ("type", "add_prefix_space", "use_regex")} for x in rest]
    plain = after == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}] and not rules["post_processor"]
    return plain and first == split and (rules["normalizer"] or {}).get("normalizers") == _LOWERED and not any(t["normalized"] for t in rules["added_tokens"])


def detached(texts: pa.Array, added: list[str]) -> pa.Array:
    """Texts with A-Z in lower case and a space before punctuation that ends a word, so that they share more words.

    Texts that hold an added token in any case stay as they are.
    """
    low = pc.ascii_lower(texts)
    kept = pa.array(np.zeros(len(texts), bool))
    for token in added:
        kept = pc.or_(kept, pc.match_substring(low, token, ignore_case=True))
    return pc.if_else(kept, texts, pc.replace_substring_regex(low, _TAIL, r"\1 \2\3"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts; one row per piece with the checksum of its ids.

    The tokenizer drops white space and never joins across it, so the ids of a text
    are those of its words in turn; a task encodes each word once and remembers it.
    """
    remembered = CACHED_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        from zlib import crc32

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        mark = encoder.encode(MARK, add_special_tokens=False).ids
        rules = json.loads(encoder.to_str())
        apart, added = cuts_punctuation(rules), [t["content"] for t in rules["added_tokens"]]

        def encode(words: list[str], known: dict[str, bytes]) -> None:
            """Many words in one call, told apart by the id of a mark that none of them holds."""
            if len(mark) != 1:
                plain, odd = [], words
            else:
                plain, odd = [w for w in words if MARK not in w], [w for w in words if MARK in w]
            groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
            lines = encoder.encode_batch_fast([f" {MARK} ".join(g) + f" {MARK}" for g in groups], add_special_tokens=False)
            for group, line in zip(groups, lines):
                ids = np.array(line.ids, "<u4")
                ends, data, at = np.flatnonzero(ids == mark[0]).tolist(), ids.tobytes(), 0
                for w, to in zip(group, ends, strict=True):
                    known[w] = data[4 * at : 4 * to]
                    at = to + 1
            for w, code in zip(odd, encoder.encode_batch_fast(odd, add_special_tokens=False)):
                known[w] = np.array(code.ids, "<u4").tobytes()

        known: dict[str, bytes] = {}
        for batch in batches:
            for part in text_slices(batch, limit=TOKEN_BYTES):
                # A new array: Arrow's ``ascii_lower`` is wrong on slices.
                texts = pc.replace_substring(pc.fill_null(part.column("text").cast(pa.large_string()), ""), "\n", " ")
                words = pc.split_pattern(detached(texts, added) if apart else texts, " ")
                coded = words.flatten().dictionary_encode()
                names = coded.dictionary.to_pylist()
                encode([w for w in names if w not in known], known)
                codes = [known[w] for w in names] + [np.array([end_id], "<u4").tobytes()]
                data = np.frombuffer(b"".join(codes), "<u4")
                sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
                # The words of all texts, each text with the end id behind it.
                last = np.cumsum(np.asarray(pc.list_value_length(words), dtype=np.int64))
                at = np.insert(np.asarray(coded.indices, dtype=np.int64), last, len(names))
                size, begin = sizes[at], (np.cumsum(sizes) - sizes)[at]
                ends = np.cumsum(size)
                ids = memoryview(data[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]).cast("B")
                to = ends[last + np.arange(len(last))]
                n = np.diff(to, prepend=0)
                pieces = -(-n // capacity)
                text = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]) * capacity
                length = np.minimum(capacity, n[text] - start)
                first = 4 * (to[text] - n[text] + start)
                crcs = [crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
                if len(known) > remembered:
                    known = {}
                columns = [part.column("doc_id").take(pa.array(text)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(n[text])]
                yield pa.RecordBatch.from_arrays(columns, schema=_PIECE_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the worth of the best pattern and its item counts."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            worth = best[room - sizes[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[room]:
                best[room], took[room] = worth[i], i
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), counts


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (item counts by class) and how often each is used, covering ``demand`` exactly.

    A revised simplex keeps the inverse of the basis. It ends within ``gap`` of the best
    bound that its prices have proved so far (the bound starts at total size over
    capacity). Counts are rounded down, and the few items left are placed best fit,
    largest first. ``sizes`` is ascending.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse @ demand.astype(float)
    bound = float(sizes @ demand) / capacity
    while amount.sum() > bound * (1 + gap):
        prices = np.maximum(inverse.sum(axis=0), 0.0)
        worth, column = best_pattern(prices, sizes, capacity)
        bound = max(bound, float(prices @ demand) / worth)
        if worth <= 1 + 1e-7:
            break
        move = inverse @ column
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * move, 0.0)
        amount[out] = step
        basis[:, out] = column
        inverse[out] /= move[out]
        others = move.copy()
        others[out] = 0.0
        inverse -= np.outer(others, inverse[out])
    used = [(basis[:, j].copy(), int(amount[j] + 1e-6)) for j in range(m)]
    left = demand.astype(np.int64).copy()
    kept = []
    for pattern, times in used:
        if times:
            held = pattern > 0
            times = min(times, int((left[held] // pattern[held]).min()))
        if times > 0:
            left -= pattern * times
            kept.append((pattern, times))
    bins: list[np.ndarray] = []
    room = np.zeros(0, dtype=np.int64)
    for c in range(m - 1, -1, -1):
        for _ in range(int(left[c])):
            fit = np.flatnonzero(room >= sizes[c])
            if len(fit):
                j = int(fit[room[fit].argmin()])
            else:
                j = len(bins)
                bins.append(np.zeros(m, dtype=np.int64))
                room = np.append(room, capacity)
            bins[j][c] += 1
            room[j] -= sizes[c]
    return kept + [(b, 1) for b in bins]


def ranked(pieces: DataFrame, rows: int, largest: int) -> DataFrame:
    """Number the pieces of every length class from 0, without one task per class."""
    buckets = max(1, -(-largest // rows))
    cut = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("_class", "_b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    if buckets == 1:
        return cut.withColumn("_rank", F.row_number().over(inside) - F.lit(1)).drop("_b")
    earlier = Window.partitionBy("_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("_class", "_b").count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    return (
        cut.withColumn("_in", F.row_number().over(inside) - F.lit(1))
        .join(before.drop("count"), ["_class", "_b"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_b", "_before", "_in")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, grain: int = GRAIN) -> DataFrame:
    """One row per piece: where its ids come from and where they lie.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    padded_length (the length of its sequence with padding: ``capacity``, or the
    sequence's own length where that is a power of two).
    """
    spark = docs.sparkSession
    # Computed once: the histogram and the assignment read the same rows.
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    full = -(-capacity // grain)
    # At most capacity / grain rows.
    histogram = dict(classed.groupBy("_class").count().collect())
    sizes = np.array(sorted(c for c in histogram if c != full), dtype=np.int64)
    demand = np.array([histogram[c] for c in sizes], dtype=np.int64)
    patterns = cutting_patterns(sizes, demand, capacity // grain)
    ranges, taken, base = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            c, each = int(sizes[i]), int(pattern[i])
            ranges.append((c, taken[c], taken[c] + each * times, each, base))
            taken[c] += each * times
        base += times
    ranges.append((full, 0, histogram.get(full, 0), 1, base))
    # Patterns are at most twice as many as classes, so this table is small for any input.
    slots = F.broadcast(spark.createDataFrame(ranges, "_class int, _lo long, _hi long, _each long, _base long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank")
    whole = Window.partitionBy("sequence_id")
    total = F.sum("length").over(whole)
    return (
        ranked(classed, RANK_ROWS, max(histogram.values(), default=0))
        .join(slots, "_class")
        .where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .withColumn("sequence_id", F.col("_base") + F.floor((F.col("_rank") - F.col("_lo")) / F.col("_each")))
        .withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
        .withColumn("padded_length", F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(F.lit(capacity)).cast("long"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")
    )
