"""Words share their parts before they are encoded; the ids stay those of the whole text."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from airspark.llm.packing import detached, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [" ", " ", " ", "\n", "a", "B", "s", "é", "É", "ß", "ÿ", "÷", "'", "'", ".", "!", "—", "=", "́", "̸", "İ", "7", "²", "日"]
SIGNS += ["\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>", "<|EndOfText|>", "<|", "'re", "ing", "ation"]


def test_one_word_for_all_its_forms():
    texts = pa.array(["Word. word, WORD! word", "No.<|endoftext|> No."], pa.large_string())
    low, kept = detached(texts, ["<|endoftext|>"]).to_pylist()
    assert set(low.split(" ")) == {"word", ".", ",", "!"}
    assert kept == "No.<|endoftext|> No."


def test_ids_are_those_of_whole_texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(SIGNS, k=rng.randrange(60)))) for i in range(3000)]
    coder = Tokenizer.from_file(PATH)
    want = {}
    for i, text in rows:
        ids = coder.encode(text, add_special_tokens=False).ids + [1]
        want[i] = (len(ids), crc32(np.array(ids, "<u4").tobytes()))
    got = token_pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH).collect()
    found = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in got}
    assert len(got) == len(rows) and {i: rows[i][1] for i in want if want[i] != found[i]} == {}
