"""Packing against the tokenizer library with its default setting."""

import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from furrow.llm import bpe, packing, queries

PARTS = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "don", "'t", " ", "  ", "\n", "rain", "é", "日本", "12", "!"]


def test_added_tokens_in_texts_are_encoded_as_tokens():
    rng, tokenizer, coder = random.Random(2), Tokenizer.from_file(queries.VOCABULARY), bpe.Encoder.load(queries.VOCABULARY)
    cases = ["a<|endoftext|>b", ""] + ["".join(rng.choices(PARTS, k=rng.randint(0, 10))) for _ in range(3000)]
    made = [x.tolist() for x in coder.encode(cases)]
    assert made[0] == [64, 50256, 65]
    assert made == [tokenizer.encode(c, add_special_tokens=False).ids for c in cases]
    assert [coder.decode(np.array(x, np.uint32)).decode() for x in made] == cases


def test_packed_pieces_hold_added_tokens(spark):
    tokenizer, texts = Tokenizer.from_file(queries.VOCABULARY), ["a<|endoftext|>b", "plain", "<|endoftext|>" * 1500]
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.VOCABULARY).collect()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in pieces)


def test_identical_rows_are_packed_in_groups_of_bounded_size(spark):
    rows = [(7, "the same text")] * 400 + [(None, "the same text")] * 400 + [(i, f"text {i}") for i in range(1000, 1400)]
    made = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), queries.VOCABULARY, group=100)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    groups = Counter(r.sequence_id % 12 for r in made.collect())
    assert sum(groups.values()) == 1200 and max(groups.values()) < 160
