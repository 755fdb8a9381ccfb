"""Chats, archives, toxicity, lines, vectors and the pipeline against brute force."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airspark.llm.chat import chat_digest, format_chats
from airspark.llm.components import connected
from airspark.llm.lines import line_report, without_repeats
from airspark.llm.topk import top_products, vectors
from airspark.llm.toxicity import FitSettings, score_all, without_toxic
from airspark.llm.warc import archive_pages, read_records
from airspark.session import scratch_path

# ---- chats ------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, segments string, state string"


def test_chats_read_back(spark):
    hard = ["</s>[INST] ok [/INST]", "~0 ~1 ~~2 [ < <s>", "", None, "[ROLE]x[/ROLE][/END]", "é😀\n[OUT]"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(hard)]
    rows += [(2, 1, "assistant", "first"), (2, 0, "system", "s"), (2, 1, "assistant", "first"), (2, None, None, "no role"), (2, 3, "to[ol<~", "r")]
    rows += [(None, 0, "user", "q"), (3, 0, "user", "x" * 100_000)]
    got = {r["conv_id"]: r for r in chat_digest(format_chats(spark.createDataFrame([(*r, None, None) for r in rows], TURN))).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        told, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["loss_chars"]) == (len(turns), len(loss))
        assert row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["violations"] == 0 and got[1]["complete"] and got[2]["violations"] == 4 and not got[3]["complete"]
    assert format_chats(spark.createDataFrame([], TURN)).collect() == []


# ---- archives ---------------------------------------------------------------


def test_archives(spark):
    big, other = "<p>é WARC/1.1\r\n\r\n" + "x" * 1000, "y" * 5000
    rows = [(1, "http://a/", big), (2, "u\r\nWARC-Type: revisit", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
            (7, "u", other), (None, "u", other), (8, "u", other), (8, "u", other), (9, "u", "")]
    schema = "page_id long, url string, html string, original string, payload_digest string"
    path = scratch_path(spark, "test-warc")
    got = sorted(archive_pages(spark.createDataFrame([(*r, None, None) for r in rows], schema), path=path).collect(), key=str)
    last = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            last[h] = max(p, last.get(h, p))
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        refers = last.get(h) if p is not None and last.get(h) != p else None
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got] == [
        w for _, w in sorted((str(next(r for r in got if tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == w)), w) for w in want)
    ]
    records = read_records(spark, path, payloads=True).collect()
    assert {r["html"] for r in records if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    files = list(Path(path.removeprefix("file:")).glob("part-*.gz"))
    assert files and all(gzip.open(f).read(8) == b"WARC/1.1" for f in files)
    assert archive_pages(spark.createDataFrame([], schema)).collect() == []


# ---- toxicity ---------------------------------------------------------------


def test_toxic_words_are_learned(spark, clashing, prose):
    rng, rows, labels = random.Random(5), [], []
    for i in range(900):
        w, toxic = prose(i, rng.randrange(20, 120), 3000), i % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "nastystem" + rng.choice("abcdefgh") * 2])
        rows.append((i, " ".join(w), rng.choice(["en", "de", None])))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "vileword vileword vileword", "en"), (1000, None, None), (1001, "", "en"), (0, " ".join(prose(7, 50)), "en")]
    table = spark.createDataFrame([*labels, (None, 1, 1), (2, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(rows)
    out = score_all(docs, table, FitSettings(epochs=4)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [(r["score"], r["doc_id"] % 3 == 0, r["predicted"]) for r in out if r["held_out"] and 0 < r["doc_id"] < 900]
    good, bad = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in out)
    kept = without_toxic(docs, table, FitSettings(epochs=4))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and {1000, 1001} <= ids and None not in ids and len(ids) > 550
    none = score_all(docs, table.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and score_all(docs.limit(0), table).collect() == []


# ---- lines ------------------------------------------------------------------


def edit(a, b):
    """Edit distance, a column of the table at a time as the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    whole, last, where = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = whole, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        right = (((same & up) + up) ^ up) | same
        more, less = down | (~(right | up) & whole), up & right
        score += bool(more & last) - bool(less & last)
        more, less = ((more << 1) | 1) & whole, (less << 1) & whole
        up, down = less | (~(same | down | more) & whole), more & (same | down)
    return score


def brute_removals(rows):
    """By doc_id: the numbers of lines that go; ids are distinct here."""
    first, places = {}, {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, raw in enumerate((text or "").split("\n")):
            line = " ".join(re.findall(r"[^\W_]+", raw.lower()))
            if line.count(" ") >= 3:
                first.setdefault(line, len(first))
                places.setdefault(line, []).append((d, i))
    lines = list(first)
    alphabet = {c: k for k, c in enumerate(sorted(set("".join(lines))))}
    letters = np.zeros((len(lines), len(alphabet)), np.int64)
    for i, line in enumerate(lines):
        for c, n in Counter(line).items():
            letters[i, alphabet[c]] = n
    sizes = letters.sum(axis=1)
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        # An edit changes at most one letter on either side, so that few pairs need the distance.
        gap = letters[:i] - letters[i]
        apart = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1))
        most = np.floor(0.1 * np.maximum(sizes[:i], sizes[i]) + 1e-9).astype(int)
        for j in np.flatnonzero(apart <= most).tolist():
            if root(i) != root(j) and edit(lines[i], lines[j]) <= most[j]:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    groups, gone = {}, {}
    for i, line in enumerate(lines):
        groups.setdefault(root(i), []).extend(places[line])
    for spots in groups.values():
        for d, i in sorted(spots, key=lambda s: (s[0] is None, s[0] or 0, s[1]))[1:]:
            gone.setdefault(d, set()).add(i)
    return gone


@pytest.mark.parametrize("crowd", [64, 2])
def test_lines_equal_brute_force(spark, clashing, prose, crowd):
    rng, rows = random.Random(2), []
    pool = [" ".join(prose(i, rng.randrange(3, 60), 500)) for i in range(25)]
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            lines.append(rng.choice([line, line.upper() + "!!", "short line"]))
        rows.append((i * 13 % 997, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, pool[3] + "\n" + pool[4]), (1003, "é à ü ñ ö\nÉ À Ü Ñ Ö")]
    docs = clashing(rows)
    got = {r["doc_id"]: r for r in line_report(docs, crowd=crowd).collect()}
    gone = brute_removals(rows)
    assert {d: sorted(map(int, filter(None, r["removed"].split(",")))) for d, r in got.items() if r["n_removed"]} == {d: sorted(x) for d, x in gone.items()}
    assert all(got[d]["n_lines"] == (len(t.split("\n")) if t else 0) and got[d]["n_removed"] == len(gone.get(d, ())) for d, t in rows)
    clean = without_repeats(docs)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and clean.count() == len(rows)
    for d, t in rows:
        assert texts[d] == (t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]))
    assert line_report(docs.limit(0)).collect() == []


def test_a_repeated_row_keeps_its_lines(spark, clashing):
    line = "one two three four five"
    got = line_report(clashing([(1, line), (1, line), (2, line), (1, line + "\n" + line)])).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["removed"]) for r in got)[0] in [(1, 1, ""), (1, 1, "0")]
    assert sum(r["n_lines"] - r["n_removed"] for r in got if r["doc_id"] == 2) == 0
    assert sum(r["n_removed"] for r in got) in (3, 4)  # either text of id 1 may come first


def test_components_of_a_long_path(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(500, 501), (501, 501), (None, 3), (503, 501)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {501: 500, 503: 500}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- vectors ----------------------------------------------------------------


def brute_top(rows, every, k):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.setdefault((i, tuple(math.floor(256 * x) for x in v)), None)
    out = set()
    for q, a in valid:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_top_products_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]
    rows += [(400, None), (401, [1.0, None]), (402, [math.nan] * 8), (403, [math.inf] * 8), (None, [1.0] * 8), (410, [1.0, 2.0]), (420, [2.0, 2.0]), (430, []), (440, [1e6] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, floor double")
    got = {tuple(r) for r in top_products(vectors(df), F.col("id") % 10 == 0, block_rows=block_rows).collect()}
    assert got == brute_top(rows, 10, 5)
    assert top_products(vectors(df.limit(0)), F.col("id") % 10 == 0).collect() == []


# ---- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        counts.append(docs.select("doc_id").distinct().count())
        if name != names[-1]:
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        if name == "line dedup":
            gone = brute_removals([tuple(r) for r in before.select("doc_id", "text").collect()])
            for r in before.join(docs.select("doc_id", F.col("text").alias("after")), "doc_id").collect():
                kept = [x for i, x in enumerate(r["text"].split("\n")) if i not in gone.get(r["doc_id"], ())]
                assert r["after"] == "\n".join(kept)
    assert counts[0] >= counts[1] and counts[1] == counts[2] >= counts[3] >= counts[4] == counts[5] > 0
