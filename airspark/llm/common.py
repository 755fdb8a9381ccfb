"""Helpers the operators share: tables, bounded Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python task turns into arrays at once; a longer text is one piece.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay within ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What ends a word made of letters and digits: all ASCII characters but those.
_NO_LETTER = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a one-to-one map."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    (whole,), counts = word_parts(texts, letters)
    return whole, counts


def word_parts(texts: pa.Array, letters: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, and where the words of each text begin (one entry more than texts).

    Words are runs of bytes other than ASCII white space, with A-Z in lower case.
    A null text has no words. With ``letters``, all ASCII punctuation ends a word too.
    The first array is for whole words, the others for their first bytes, as many as
    ``prefixes`` say (the whole word where it is shorter).
    """
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if texts.null_count:
        return word_parts(pc.fill_null(texts, ""), letters, prefixes)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return [np.empty(0, np.uint64)] * (1 + len(prefixes)), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    solid = ~(_NO_LETTER if letters else _SPACE)[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = solid[first]  # a word ends where its text ends
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [np.empty(0, np.uint64)] * (1 + len(prefixes)), np.zeros(n + 1, np.int64)
    counts = np.searchsorted(starts, at)
    place = np.arange(starts[0], len(raw), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    longest = int(place[solid[starts[0] :]].max()) + 1
    powers = np.full(longest, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = _LOWER[raw[starts[0] :]] + np.uint64(1)
    values *= powers[np.minimum(place, longest - 1)]
    values[~solid[starts[0] :]] = 0
    at = starts - starts[0]
    parts = [mix(np.add.reduceat(values, at))]
    for size in sorted(prefixes, reverse=True):
        values[place >= size] = 0
        parts.insert(1, mix(np.add.reduceat(values, at)))
    return parts, counts


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of ``k`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = out * _STEPS[j % 5] + words[j : len(words) - k + 1 + j]
    return mix(out)


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))
