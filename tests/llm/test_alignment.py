"""Tokens of two tokenizers aligned: groups, links and counts against a plain version."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm import alignment, registry
from claimloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "B", "7", " ", " ", "\n", "\t", "'s", ".", "—", "é", "́", "日", "　", " ", "<|endoftext|>", "▁", "</s>", "<0x41>", "ﬁ", "q" * 30]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Plain:
    """Whole texts by both public tokenizers, groups by comparing all ends."""

    def __init__(self):
        self.a = Tokenizer.from_file(VOCABULARY)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in signs} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in signs)}

    def groups(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a_raw = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        b_raw = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            return []
        a_ends, b_ends = list(accumulate(map(len, a_raw))), list(accumulate(map(len, b_raw)))
        out, low = [], 0
        for end in [e for e in a_ends if e in set(b_ends)]:
            out.append(([i for i, e in zip(a, a_ends) if low < e <= end], [i for i, e in zip(b, b_ends) if low < e <= end]))
            low = end
        return out

    def rows(self, texts):
        groups = [self.groups(t or "") for t in texts]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
        count = Counter(p for own in links for p in own)
        high = {}
        for (x, _), n in count.items():
            high[x] = max(high.get(x, 0), n)
        for g, own in zip(groups, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (
                sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
                sum(n for p, n in own.items() if count[p] == high[p[0]]), sum(n * count[p] for p, n in own.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_common_ends_slice_both_lists():
    assert alignment.common_ends([2, 3, 7, 9], [1, 3, 9]) == ([0, 2, 4], [0, 2, 3])


@pytest.mark.parametrize("large", [1 << 14, 2])
def test_texts_equal_the_plain_version(plain, monkeypatch, large):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    aligner = alignment.Aligner(open(VOCABULARY, encoding="utf-8").read(), open(MODEL, "rb").read())
    rng = random.Random(4)
    texts = ["".join(rng.choices(SIGNS[: 21 - 5 * (n % 2)], k=rng.randint(0, 30))) for n in range(300)]
    for text, found in zip(texts, aligner.of(texts)):
        groups = plain.groups(text)
        assert (found is None) == (not groups)
        if found:
            links = Counter(x << 32 | y for a, b in groups for x in a for y in b)
            assert dict(zip(found.codes.tolist(), found.times.tolist())) == links
            assert found.groups_sha256 == list(plain.rows([text]))[0][-1]


def test_whole_table(spark, plain):
    docs = table(spark, SMALL, "documents").collect()
    wanted = dict(zip([d["doc_id"] for d in docs], plain.rows([d["text"] for d in docs])))
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in registry.op11_alignment(spark, SMALL).collect()}
    assert found == wanted


def test_counts_over_many_batches(spark, plain):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "beta", "xqzt", "naïve", "", "\n"], k=rng.randint(0, 9))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in alignment.align(docs, VOCABULARY, MODEL, batch_length=300).collect()}
    assert [found[i] for i in range(120)] == list(plain.rows(texts))


def test_alignment_edges(odd, plain):
    rows = odd.select("doc_id", "text").collect()
    wanted = sorted(plain.rows([r["text"] for r in rows if len(r["text"] or "") < 1000]))
    found = [r for r in alignment.align(odd.withColumn("batch", F.lit(1)).withColumn("pairs", F.lit(2)), VOCABULARY, MODEL).collect()]
    assert len(found) == 8 and sorted(tuple(r[c] for c in NAMES if c not in ("n_best", "count_sum")) for r in found if r["doc_id"] != 5) == sorted(
        w[:4] + w[6:] for w in wanted
    )
    assert [tuple(r)[1:] for r in found if r["doc_id"] == 2] == [(0, 0, 0, 0, 0, 0, "")]
    assert [r["n_a"] > 40_000 and r["n_best"] > 0 for r in found if r["doc_id"] == 5] == [True]
    assert alignment.align(odd.limit(0), VOCABULARY, MODEL).count() == 0
