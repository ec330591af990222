"""Language-model scores of whole texts from an Elias-Fano n-gram trie that the corpus fills.

Counting and scoring share one exchange. Texts are read in batches of about two million tokens. A batch is
reduced to its distinct words and distinct word pairs with their training counts, sorted by the hash of the
first word, and cut into shards of that hash: this one message adds to the counts and asks for them. A shard
adds up the messages of all batches, builds its part of the trie, looks every asked n-gram up in it and
answers each batch in the order it asked. The batch then scores its texts from its answers alone. A word
pair that fills a third of the corpus is one entry in each batch's message.

The trie has a level of contexts and a level of successors. Each is a rising Elias-Fano sequence: contexts
by their 64-bit hash, successors by (place of the context, 32-bit fingerprint), so a word's place is relative
to its context and a lookup is one successor search. Pointers from contexts to their successors are a
third sequence. Probabilities are kept as 16-bit steps of their logarithm. The levels lie in one file that
is mapped into memory while the shard answers.

The model is interpolated absolute discounting over word pairs,

    P(w | h) = max(c(h w) - D, 0) / c(h) + D T(h) / c(h) * (c(w) + 1) / (N + V + 1),

with T(h) the number of distinct successors of h. The start of a text is a context and its end a token;
both are one edge symbol, whose count is the number of training texts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import with_id
from claimloom.llm.elias_fano import EliasFano, packed, unpacked
from claimloom.llm.hashing import batches, mix, word_hashes
from claimloom.sinks import stage

DISCOUNT = 0.75
BATCH_TOKENS = 1 << 21
SLICE = 512
#: Bytes of text for each shard of the trie.
SHARD_BYTES = 1 << 24
EDGE = mix(np.array([0x45444745], np.uint64))[0]
#: Steps of the quantised logarithms: 0 stands for a probability of zero.
STEP = 12.0 / 65534

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in (0x20, 9, 10, 11, 12, 13) else b for b in range(256))

_ASK = "shard int, batch string, contexts binary, successors binary, words binary, counts binary"
_TEXTS = "train array<boolean>, lengths array<int>, distinct long, words binary"
_ANSWER = "batch string, shard int, counts binary, spread binary, chances binary, tokens long, types long"


def quantised(p: np.ndarray) -> np.ndarray:
    steps = np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP) + 1
    return np.where(p > 0, np.minimum(steps, 65535), 0).astype(np.uint16)


def chance(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 10.0 ** (-(q.astype(np.float64) - 1) * STEP), 0.0)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the hash, so sorted hashes lie shard after shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Batch:
    """Texts as one sequence of places in a sorted table of distinct word hashes, with an edge around each."""

    def __init__(self, hashes: list[np.ndarray]):
        parts = [np.array([EDGE], np.uint64)]
        for h in hashes:
            parts += [h, parts[0]]
        self.lengths = np.array([len(h) + 1 for h in hashes], np.int64)
        self.table, self.places = np.unique(np.concatenate(parts), return_inverse=True)

    @staticmethod
    def pairs(places: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (context * distinct + word), sorted, and which one each token is."""
        keys = places[:-1].astype(np.int64) * distinct + places[1:]
        return np.unique(keys, return_inverse=True)


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, pa.Array, Batch]]:
    """Batches of texts in the order of the partition, each with a name that its content decides."""
    held: list[np.ndarray] = []
    ids: list[pa.Array] = []
    train: list[pa.Array] = []
    size, number = 0, 0

    def closed():
        batch = Batch(held)
        with np.errstate(over="ignore"):
            digest = int((batch.table * mix(np.arange(len(batch.table), dtype=np.uint64))).sum()) ^ len(batch.places)
        return f"{TaskContext.get().partitionId()}:{number}:{digest:x}", pa.concat_arrays(ids), pa.concat_arrays(train), batch

    for row in (whole.slice(at, SLICE) for whole in rows for at in range(0, whole.num_rows, SLICE)):
        texts = row.column("text").to_pylist()
        for first, last in batches(texts, 1 << 20):
            words, offsets = word_hashes([t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts[first:last]])
            held += [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            ids.append(row.column("doc_id").slice(first, last - first))
            train.append(row.column("train").slice(first, last - first))
            size += len(words)
            if size >= BATCH_TOKENS:
                yield closed()
                held, ids, train, size, number = [], [], [], 0, number + 1
    if held:
        yield closed()


def _asked(rows: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for name, _, train, batch in _texts(rows):
        keys, which = Batch.pairs(batch.places, len(batch.table))
        counts = np.bincount(which, np.repeat(np.array(train.to_pylist(), bool), batch.lengths), len(keys)).astype(np.uint32)
        context, word = keys // len(batch.table), keys % len(batch.table)
        many = np.bincount(context, minlength=len(batch.table)).astype(np.uint32)
        fingerprint = (batch.table[word] >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(shard_of(batch.table, shards), np.arange(shards + 1))
        ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                p, q = ends[a], ends[b]
                yield pa.RecordBatch.from_pylist(
                    [{"shard": s, "batch": name, "contexts": batch.table[a:b].tobytes(), "successors": many[a:b].tobytes(), "words": fingerprint[p:q].tobytes(), "counts": counts[p:q].tobytes()}],
                    schema=pa.schema([("shard", pa.int32()), ("batch", pa.string()), *[(c, pa.binary()) for c in ("contexts", "successors", "words", "counts")]]),
                )


def _streams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, ids, train, batch in _texts(rows):
        width = max(1, (len(batch.table) - 1).bit_length())
        # The sequence begins with an edge; what follows are the tokens.
        words = packed(batch.places[1:], width).tobytes()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, train, pa.array(batch.lengths.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), *lists, pa.array([len(batch.table)], pa.int64()), pa.array([words], pa.binary())],
            ["batch", "ids", "train", "lengths", "distinct", "words"],
        )


class Trie:
    """One shard's levels, mapped from a file while it is open."""

    def __init__(self, contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        """``contexts``: sorted hashes; ``keys``: rising (place of context << 32 | fingerprint)."""
        n = len(contexts)
        parent = (keys >> np.uint64(32)).astype(np.int64)
        total = np.bincount(parent, counts, n)
        types = np.bincount(parent, minlength=n)
        self.level1 = EliasFano.of(contexts, 1 << 64)
        self.level2 = EliasFano.of(keys, max(1, n) << 32)
        self.pointers = EliasFano.of(np.concatenate([[0], np.cumsum(types)]), len(keys) + 1)
        kept = {
            "total": total.astype(np.uint64),
            "spread": quantised(DISCOUNT * types / np.maximum(total, 1)),
            "chances": quantised(np.maximum(counts - DISCOUNT, 0) / np.maximum(total[parent], 1)),
        }
        self.file = tempfile.TemporaryFile()
        for name, part in (("level1", self.level1), ("level2", self.level2), ("pointers", self.pointers)):
            for which, array in part.arrays().items():
                setattr(part, which, self._mapped(array))
        for name, array in kept.items():
            setattr(self, name, self._mapped(array))

    def _mapped(self, array: np.ndarray) -> np.ndarray:
        if not array.size:
            return array
        at = self.file.seek(0, 2)
        at += -at % 64
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(array).tobytes())
        self.file.flush()
        return np.memmap(self.file, array.dtype, "r", at, array.shape)

    def find(self, level: EliasFano, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where the level does not hold it."""
        return level.place(keys) if level.n else np.full(len(keys), -1)


def _answers(table: pa.Table) -> pa.Table:
    messages = sorted(table.to_pylist(), key=lambda m: m["batch"])
    read = [{k: np.frombuffer(m[k], np.uint64 if k == "contexts" else np.uint32) for k in ("contexts", "successors", "words", "counts")} for m in messages]
    # Contexts and successors that occur in training, added up over the messages.
    seen = [np.repeat(r["contexts"], r["successors"])[r["counts"] > 0] for r in read]
    contexts = np.unique(np.concatenate(seen))
    keys = [(np.searchsorted(contexts, h).astype(np.uint64) << np.uint64(32)) | r["words"][r["counts"] > 0] for h, r in zip(seen, read)]
    keys, where = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(where, np.concatenate([r["counts"][r["counts"] > 0] for r in read]), len(keys))
    trie = Trie(contexts, keys, counts)
    tokens, types = int(counts.sum()), len(contexts)
    rows = []
    for number, (m, r) in enumerate(zip(messages, read)):
        place = trie.find(trie.level1, r["contexts"])
        of_pair = np.repeat(place, r["successors"])
        known = of_pair >= 0
        chances = np.zeros(len(of_pair), np.uint16)
        found = trie.find(trie.level2, (of_pair[known].astype(np.uint64) << np.uint64(32)) | r["words"][known])
        chances[np.flatnonzero(known)[found >= 0]] = trie.chances[found[found >= 0]]
        total, spread = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint16)
        total[place >= 0], spread[place >= 0] = trie.total[place[place >= 0]], trie.spread[place[place >= 0]]
        rows.append(
            {"batch": m["batch"], "shard": m["shard"], "counts": total.tobytes(), "spread": spread.tobytes(), "chances": chances.tobytes(), "tokens": 0 if number else tokens, "types": 0 if number else types}
        )
    trie.file.close()
    names = ("batch", "shard", "counts", "spread", "chances", "tokens", "types")
    types_ = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_pylist(rows, schema=pa.schema(list(zip(names, types_))))


def _scored(texts: pa.Table, answers: pa.Table, tokens: int, types: int) -> pa.Table:
    row = {c: texts.column(c)[0] for c in texts.schema.names}
    parts = sorted(answers.select(["shard", "counts", "spread", "chances"]).to_pylist(), key=lambda p: p["shard"])
    count, spread, chances = (
        np.concatenate([np.frombuffer(p[c], kind) for p in parts] or [np.zeros(0, kind)])
        for c, kind in (("counts", np.uint64), ("spread", np.uint16), ("chances", np.uint16))
    )
    lengths = row["lengths"].values.to_numpy().astype(np.int64)
    distinct = row["distinct"].as_py()
    width = max(1, (distinct - 1).bit_length())
    words = unpacked(np.frombuffer(row["words"].as_py(), np.uint64), width, np.arange(int(lengths.sum()))).astype(np.int64)
    # The edge comes first in the sequence; the last token of the batch is one.
    places = np.concatenate([words[-1:], words])
    keys, which = Batch.pairs(places, distinct)
    if len(count) != distinct or len(chances) != len(keys):
        raise RuntimeError("the texts were not read alike twice; store them as a table first")
    every = tokens + types + 1
    base = np.log10((count.astype(np.float64) + 1) / every)
    # An unknown context leaves everything to the single words.
    share = np.where(count > 0, chance(spread), 1.0)
    context, word = keys // distinct, keys % distinct
    model = np.log10(chance(chances) + share[context] * 10.0 ** base[word])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return pa.table(
        {
            "doc_id": row["ids"].values,
            "train": row["train"].values,
            "n_tokens": lengths,
            "n_known": np.add.reduceat((count > 0)[words].astype(np.int64), starts),
            "train_tokens": np.full(len(lengths), tokens, np.int64),
            "base_score": np.add.reduceat(base[words], starts),
            "score": np.add.reduceat(model[which], starts),
        }
    )


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Rows where ``train`` is true (null is false) are learned from. Null texts are empty ones: their only token
    is the end. ``base_score`` is the add-one unigram score, exact; ``score`` the model's log10 probability.
    Without training texts every token has chance 1. Repeated rows count and come out each; an empty table
    gives an empty result; other columns are not read. Texts are read twice and must come in the same
    partitions both times, as stored tables do; if they do not, the run fails instead of mixing answers.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    asked = rows.mapInArrow(lambda it: _asked(it, shards), _ASK)
    answers = stage(asked.groupBy("shard").applyInArrow(_answers, _ANSWER), "trie-answers")
    tokens, types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    id_type = docs.schema[id_col].dataType
    head = [T.StructField("batch", T.StringType()), T.StructField("ids", T.ArrayType(id_type))]
    streams = rows.mapInArrow(_streams, T.StructType([*head, *T.StructType.fromDDL(_TEXTS).fields]))
    return (
        streams.groupBy("batch")
        .cogroup(answers.drop("tokens", "types").groupBy("batch"))
        .applyInArrow(
            lambda t, a: _scored(t, a, tokens, types),
            with_id(docs, id_col, "doc_id", "train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"),
        )
    )
