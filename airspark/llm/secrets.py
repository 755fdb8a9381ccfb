"""Secret scans with a worklist of decoded layers.

Every text is a layer. A layer is scanned, then unwrapped: percent signs, Unicode
escapes and character references are decoded in place, base64 runs become layers of
their own, and compressed contents of such runs are expanded. New layers join the
worklist until none is new; a layer whose content was seen at the same place ends its
branch, so cycles end and equal contents at other places are found there too. Each character of a layer knows the characters of the whole text it came from.

Defined cases: a null text is an empty one without spans; null and repeated ids are
scanned like any other row; equal spans of several layers count once; an empty table
gives an empty result; other columns are not read. Expanded contents over
``max_layer`` bytes are not scanned (a bound on memory); ``n_refused`` counts them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airspark.llm.common import arrow_schema, text_slices

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Words of which one stands in every text that ASSIGN matches.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|\\U[0-9A-Fa-f]{8}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
URL_SAFE = str.maketrans("-_", "+/")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns; a run too short is no match."""
    found = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode()
    except ValueError:
        return None


def _escape(run: str) -> str | None:
    try:
        if run.startswith("\\u"):
            return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be")
        if run.startswith("\\x"):
            return bytes.fromhex(run.replace("\\x", "")).decode()
        digits = run[2:].strip("xX;")
        return chr(int(digits, 16 if run[1] == "U" or run[2] in "xX" else 10))
    except (ValueError, OverflowError):
        return None


def _expand(data: bytes, limit: int) -> tuple[bytes | None, bool]:
    """The content of a gzip or zlib stream, and whether it is too large."""
    import zlib

    stream = zlib.decompressobj(wbits=47)
    try:
        out = stream.decompress(data, limit + 1)
    except zlib.error:
        return None, False
    return (None, True) if len(out) > limit else (out, False)


def _text(data: bytes) -> str | None:
    """UTF-8 text of mostly printable characters."""
    try:
        text = data.decode()
    except ValueError:
        return None
    odd = sum(not (c.isprintable() or c in "\r\n\t") for c in text)
    return text if text and odd * 10 <= len(text) else None


class Layer:
    """A text, and for each of its characters the span of the whole text behind it."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def key(self) -> tuple[str, bytes]:
        """The content and a digest of the place it came from."""
        from hashlib import blake2b

        return self.text, blake2b(self.starts.tobytes() + self.ends.tobytes()).digest()

    def replaced(self, pattern: re.Pattern, decode) -> "Layer | None":
        """The layer with every run that ``decode`` understands decoded in place."""
        texts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if (new := decode(m[0])) is None:
                continue
            texts += [self.text[at : m.start()], new]
            starts += [self._starts(at, m.start()), np.full(len(new), self.origin(*m.span())[0])]
            ends += [self._ends(at, m.start()), np.full(len(new), self.origin(*m.span())[1])]
            at = m.end()
        if not texts:
            return None
        texts.append(self.text[at:])
        starts.append(self._starts(at, len(self.text)))
        ends.append(self._ends(at, len(self.text)))
        return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))

    def _starts(self, a: int, b: int) -> np.ndarray:
        return np.arange(a, b) if self.starts is None else self.starts[a:b]

    def _ends(self, a: int, b: int) -> np.ndarray:
        return np.arange(a + 1, b + 1) if self.ends is None else self.ends[a:b]


def unwrapped(layer: Layer, limit: int) -> Iterator[Layer | None]:
    """Layers inside a layer; None for a content over the limit."""
    from base64 import b64decode

    if "%" in layer.text and (new := layer.replaced(PERCENT, _percent)):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := layer.replaced(ESCAPED, _escape)):
        yield new
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=").translate(URL_SAFE)
        if len(run) % 4 == 1:
            run = run[:-1]
        data = b64decode(run + "=" * (-len(run) % 4))
        packed = data[:2] == b"\x1f\x8b" or data[:1] == b"\x78"
        whole = layer.origin(*m.span())
        if packed:
            content, large = _expand(data, limit)
            if large:
                yield None
            elif content and (text := _text(content)) is not None:
                yield Layer(text, np.full(len(text), whole[0]), np.full(len(text), whole[1]))
                continue
        if (text := _text(data)) is not None:
            # Byte b comes from the characters 4b/3 to 4(b+1)/3 of the run.
            size = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
            until = np.cumsum(size)
            first, last = (until - size) * 4 // 3, np.minimum(-(-until * 4 // 3), len(run)) - 1
            first, last = first + m.start(), last + m.start()
            yield Layer(
                text,
                first if layer.starts is None else layer.starts[first],
                last + 1 if layer.ends is None else layer.ends[last],
            )


def find_secrets(text: str, limit: int = MAX_LAYER) -> tuple[list, list, int, int]:
    """Base spans, all spans (both sorted), the number of layers and of refused contents."""
    base = sorted(scan(text))
    spans, refused = set(base), 0
    # Equal contents are scanned once and mapped to every place; ``seen`` holds no key of the text itself.
    work, seen, scans = [Layer(text)], set(), {}
    while work:
        layer = work.pop()
        if layer.starts is not None:
            if layer.text not in scans:
                scans[layer.text] = scan(layer.text)
            for start, kind, end in scans[layer.text]:
                a, b = layer.origin(start, end)
                spans.add((a, kind, b))
        for inner in unwrapped(layer, limit):
            if inner is None:
                refused += 1
            elif (key := inner.key()) not in seen:
                seen.add(key)
                work.append(inner)
    return base, sorted(spans), 1 + len(seen), refused


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long"
_RESULT_ARROW = arrow_schema(
    doc_id=pa.int64(), n_assign=pa.int64(), n_access=pa.int64(), n_hex=pa.int64(),
    base_sha256=pa.string(), spans=pa.string(), n_layers=pa.int64(), n_refused=pa.int64(),
)


def secret_spans(docs: DataFrame, max_layer: int = MAX_LAYER) -> DataFrame:
    """Spans of secrets in every whole text, also inside nested encodings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    base, spans, layers, refused = find_secrets(text or "", max_layer)
                    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((doc, *counts, sha256(joined(base).encode()).hexdigest(), joined(spans), layers, refused))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT_ARROW)], schema=_RESULT_ARROW
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
