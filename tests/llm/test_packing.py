"""Sequences: best fit, cuts, ids as the public tokenizer gives them, and packing rounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimloom.llm import packing, registry
from claimloom.llm.common import table
from claimloom.llm.units import ByteLevel, glued

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def plain_best_fit(sizes, capacity):
    fills = []
    for size in sorted(sizes, reverse=True):
        fitting = [f for f in fills if f + size <= capacity]
        if fitting:
            fills[fills.index(max(fitting))] += size
        else:
            fills.append(size)
    return sorted(fills)


def test_best_fit_is_the_plain_one():
    for seed in range(40):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 60))]
        bins, places, fills = packing.best_fit(sizes, 20)
        assert sorted(fills) == plain_best_fit(sizes, 20)
        held = defaultdict(list)
        for b, p, s in zip(bins, places, sizes):
            held[b].append((p, s))
        for b, own in held.items():
            assert [p for p, _ in sorted(own)] == [sum(s for _, s in sorted(own)[:i]) for i in range(len(own))]
            assert sum(s for _, s in own) == fills[b] <= 20


def test_only_the_first_piece_is_short():
    assert packing.cuts(5, 8) == [(0, 5)] and packing.cuts(8, 8) == [(0, 8)]
    assert packing.cuts(19, 8) == [(0, 3), (3, 8), (11, 8)] and packing.cuts(16, 8) == [(0, 8), (8, 8)]


ODD_TEXTS = [
    "", " ", "  ", "a", " a", "a  b", "a \n b\n\n c ", "\ta  b　 c", "it's  we'll 12 345,67 x<|endoftext|> y", "x \n <|endoftext|>z",
    "<|endoftext|>", "héllo wörld ́ é", "日本 語のテキスト", "\U0001f600 ‍❤️ ok", "tab\t end\x1c here\x85 now", "  two  spaces   three",
]


def test_units_encode_as_the_whole_text(tokenizer):
    encoder = packing.Encoder(open(VOCABULARY, encoding="utf-8").read())
    rng = random.Random(3)
    signs = ["a", "B", "7", " ", " ", "\n", "\t", "'s", ".", "—", "é", "́", "日", "　", " ", "<|endoftext|>", "▁"]
    texts = ODD_TEXTS + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(600)]
    for text, ids in zip(texts, encoder.of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    encoder.known.old = encoder.known.new = {}
    for text in texts[:200]:
        assert np.frombuffer(encoder.of([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_fast_encoder_is_in_use():
    assert ByteLevel(open(VOCABULARY, encoding="utf-8").read(), False).fast is not None
    assert glued("a  b c".split(" ")) == ["a  b", "c"] and glued("a \n b".split(" ")) == ["a \n", "b"]


def checked(rows, texts, tokenizer, capacity):
    """The number of sequences, after every piece was compared with the ids of its document."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[key], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(n, *c) for n, c in enumerate(packing.cuts(len(ids), capacity))]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    return len(sequences)


def test_packed_documents(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    rows = registry.op13_packing(spark, SMALL).collect()
    assert checked(rows, texts, tokenizer, 2048) <= 1.02 * total / 2048 + 1


def test_rounds_merge_what_blocks_left(spark, tokenizer):
    """Many small blocks, each with an underfull sequence, in groups of a few sequences."""
    rng = random.Random(8)
    texts = {i: " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 12))) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(40)
    lengths = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values()]
    for group in (1 << 17, 9):
        rows = packing.pack(docs, VOCABULARY, capacity=40, near=2, group=group).collect()
        assert checked(rows, texts, tokenizer, 40) <= 1.1 * sum(lengths) / 40


def test_large_pieces_that_never_fit_together_end_the_rounds(spark, tokenizer):
    docs = spark.createDataFrame([(i, "word " * 20 + "end") for i in range(60)], "doc_id long, text string").repartition(6)
    rows = packing.pack(docs, VOCABULARY, capacity=40, near=2, group=10).collect()
    assert len({r["sequence_id"] for r in rows}) == 60


def test_packing_edges(spark, odd, tokenizer):
    rows = packing.pack(odd, VOCABULARY, with_ids=True).collect()
    assert sum(r["piece"] == 0 for r in rows) == 8 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (2, 3)) == [1, 1]
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    long = sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert len(long) > 10 and {r["length"] for r in long[1:]} == {2048} and long[0]["start"] == 0
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0
