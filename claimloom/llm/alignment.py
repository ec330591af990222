"""Alignment of the tokens of two tokenizers over the same text, and how often their ids meet in a corpus.

Both token lists cover the same bytes. A dictionary from each token's end to its index is made for either
list; the ends both have, found by intersecting the two key sets and sorted, slice the lists into groups, and
each group links all its tokens of one side with all of the other. Units that both tokenizers encode by
themselves (see ``units``) are encoded once a worker and remembered.

Counting goes by batches of a few megabytes of text. A batch sends each id pair it holds once, with the
number of its documents; Spark adds the numbers up, and every batch gets the totals of its own pairs back. So
a pair that all documents hold costs a row for each batch, and no document's links are sent anywhere.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.units import ByteLevel, Memory, glued, split_at
from claimloom.sinks import stage

BATCH_LENGTH = 1 << 21
#: Links of a group from which on it is expanded by distinct ids.
LARGE_GROUP = 1 << 14
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"

_HELD = "batch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<long>, pairs array<long>, documents array<int>"
_RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of either list lie before each end that both have, in order, from none on."""
    a_index, b_index = dict(zip(a_ends, count(1))), dict(zip(b_ends, count(1)))
    common = sorted(a_index.keys() & b_index.keys())
    return [0, *map(a_index.__getitem__, common)], [0, *map(b_index.__getitem__, common)]


def links(a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs that share a group, as a << 32 | b in order, and the number of links of each."""
    starts, sizes = cuts[:-1], np.diff(cuts, axis=0)
    many = sizes[:, 0] * sizes[:, 1]
    large = many > LARGE_GROUP
    codes, times = [], []
    for g in np.flatnonzero(large):
        (x, m), (y, n) = (
            np.unique(side[at : at + size], return_counts=True) for side, at, size in zip((a, b), starts[g], sizes[g])
        )
        codes.append((x[:, None] << 32 | y[None, :]).ravel())
        times.append((m[:, None] * n[None, :]).ravel())
    group = np.repeat(np.flatnonzero(~large), many[~large])
    place = np.arange(len(group)) - np.repeat(np.cumsum(many[~large]) - many[~large], many[~large])
    width = sizes[group, 1]
    code, n = np.unique(a[starts[group, 0] + place // width] << 32 | b[starts[group, 1] + place % width], return_counts=True)
    if not codes:
        return code, n
    return summed(np.concatenate([*codes, code]), np.concatenate([*times, n]))


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(codes, return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, place, times)
    return distinct, totals


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups_sha256: str
    codes: np.ndarray
    times: np.ndarray


class Aligner:
    """Both tokenizers, and the ids of the units that a worker has met lately."""

    def __init__(self, vocabulary: str, model: bytes):
        self.a = ByteLevel(vocabulary, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_raw = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_raw, self.a_length = self.a.raw, self.a.lengths
        self.b_length = np.array([len(x) for x in self.b_raw], np.int64)
        #: How each id is written: after the sign that opens a group of its side, or after a comma.
        n, m = len(self.a_length), len(self.b_length)
        self.written = [f"{sign}{i}" for sign, size in ((";", n), (",", n), ("|", m), (",", m)) for i in range(size)]
        #: Texts may be cut only if no piece goes on behind a space mark that follows another sign.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known = Memory(self.encode_units)

    def encode_units(self, units: list[str]) -> list[tuple[bytes, bytes] | bool]:
        """Ids of either side for a space and each unit; False if those of a side do not add up to its bytes."""
        usual = self.a.usual(units)
        if usual:
            text, sizes = " ".join(usual), [len(u.encode()) + 1 for u in usual]
            ids = self.b.encode(text)
            whole = b"".join(map(self.b_raw.__getitem__, ids)) == b" " + text.encode()
            b_ids = split_at(np.array(ids, np.int32), self.b_length, sizes) if whole else None
            if b_ids and len(usual) == len(units):
                return list(zip(self.a.together(usual, sizes), b_ids))
            done = dict(zip(usual, zip(self.a.together(usual, sizes), b_ids))) if b_ids else {}
        else:
            done = {}
        return [done.get(u) or self._alone(u) for u in units]

    def _alone(self, unit: str) -> tuple[bytes, bytes] | bool:
        a, b = self.a.encode(f" {unit}"), array("i", self.b.encode(unit)).tobytes()
        return (a, b) if self._covered(unit, a, b) else False

    def _covered(self, unit: str, *sides: bytes) -> bool:
        raw = b" " + unit.encode("utf-8", "surrogatepass")
        return all(
            b"".join([table[i] for i in array("i", ids)]) == raw for ids, table in zip(sides, (self.a_raw, self.b_raw))
        )

    def of(self, texts: list[str]) -> list[Aligned | None]:
        """Whole texts aligned; None for an empty one and where a side does not add up to its bytes."""
        parts = [t.split(" ") if self.cuttable else [t] for t in texts]
        found = self.known.of(parts)
        out = []
        for text, own, units in zip(texts, parts, found):
            if None in units:
                units = self.encode_units(glued(own))
            out.append(self._aligned(*zip(*units)) if text and False not in units else None)
        return out

    def _aligned(self, a_units: list[bytes], b_units: list[bytes]) -> Aligned:
        a, b = (np.frombuffer(b"".join(units), np.int32).astype(np.int64) for units in (a_units, b_units))
        cuts = np.array(common_ends(np.cumsum(self.a_length[a]).tolist(), np.cumsum(self.b_length[b]).tolist()), np.int64).T
        codes, times = links(a, b, cuts)
        digest = hashlib.sha256(self._groups(a, b, cuts).encode()).hexdigest()
        return Aligned(len(a), len(b), len(cuts) - 1, int(times.sum()), digest, codes, times)

    def _groups(self, a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: the ids of each group, side by side."""
        sizes = np.diff(cuts, axis=0)
        out = np.empty(len(a) + len(b), np.int64)
        a_word, b_word = a + len(self.a_length), b + 2 * len(self.a_length) + len(self.b_length)
        a_word[cuts[:-1, 0]] -= len(self.a_length)
        b_word[cuts[:-1, 1]] -= len(self.b_length)
        out[np.arange(len(a)) + np.repeat(cuts[:-1, 1], sizes[:, 0])] = a_word
        out[np.arange(len(b)) + np.repeat(cuts[1:, 0], sizes[:, 1])] = b_word
        return "".join(map(self.written.__getitem__, out.tolist()))[1:]


_last: list = [None, None]


def _aligner(shared) -> Aligner:
    """The aligner of the worker's last task, if it was for the same broadcast files."""
    if _last[0] is not shared:
        _last[:] = shared, Aligner(*shared.value)
    return _last[1]


class _Batch:
    """The documents of a batch on their way out."""

    def __init__(self):
        self.keys, self.rows, self.codes, self.times, self.length = [], [], [], [], 0

    def add(self, key: pa.Array, text: str, found: Aligned | None) -> None:
        found = found or Aligned(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys.append(key)
        self.rows.append(found[:5])
        self.codes.append(found.codes)
        self.times.append(found.times)
        self.length += len(text) + 64

    def out(self, number: int, names: list[str]) -> pa.RecordBatch:
        pairs, place, documents = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        n = len(self.rows)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in self.codes])]), pa.int32())
        once = pa.array([0] + [len(pairs)] * n, pa.int32())  # the first row carries the pairs of the batch
        *numbers, digests = zip(*self.rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(self.keys), pa.array([number] * n, pa.int64()), *[pa.array(c, pa.int64()) for c in numbers],
                pa.array(digests), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(self.times))),
                pa.ListArray.from_arrays(once, pa.array(pairs)), pa.ListArray.from_arrays(once, pa.array(documents, pa.int32())),
            ],
            names,
        )


def align(
    docs: DataFrame, vocabulary_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    batch_length: int = BATCH_LENGTH,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``.

    A is the byte-level vocabulary over a space and the text, B the piece model over the text. A pair's count is
    the number of rows that hold it linked, over the whole table; ``n_best`` counts links whose pair has the
    highest count of its A id, ties included. Null and empty texts, and texts whose tokens of either side do not
    add up to their bytes, have zeros and an empty hash. Repeated rows and rows without an id count and come out
    each, an empty table gives no rows, other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as vocabulary, open(model_path, "rb") as model:
        shared = spark.sparkContext.broadcast((vocabulary.read(), model.read()))
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    held = T.StructType([id_field, *T.StructType.fromDDL(_HELD).fields])
    names = held.fieldNames()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, batch = _aligner(shared), TaskContext.get().partitionId() << 32, _Batch()
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                part_texts = [t or "" for t in part.column("text").to_pylist()]
                for i, (text, found) in enumerate(zip(part_texts, aligner.of(part_texts))):
                    batch.add(part.column("doc_id").slice(i, 1), text, found)
                    if batch.length > batch_length:
                        yield batch.out(number, names)
                        number, batch = number + 1, _Batch()
        if batch.rows:
            yield batch.out(number, names)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(texts.mapInArrow(aligned, held), "aligned")
    sent = rows.filter(F.size("pairs") > 0)
    each = sent.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x")).select("x.pairs", "x.documents")
    counts = stage(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("n")), "pair-counts")
    # One row for each id of the A vocabulary at most, which is a file of fixed size: a broadcast of bounded size.
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("high"))
    ranked = counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("high")).alias("best"))
    asked = sent.select(F.col("batch").alias("home"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(ranked, "pair").select("home", "place", "n", "best")
    kept = rows.select("doc_id", "batch", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    result = T.StructType([id_field, *T.StructType.fromDDL(_RESULT).fields])
    return kept.groupBy("batch").cogroup(answers.groupBy("home")).applyInArrow(_totals, result)


def _totals(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The links of each document, weighed with the totals of their pairs."""
    order = np.argsort(answers.column("place").to_numpy())
    n, best = answers.column("n").to_numpy()[order], answers.column("best").to_numpy()[order]
    lengths = np.array(rows.column("places").combine_chunks().value_lengths())
    place = rows.column("places").combine_chunks().flatten().to_numpy()
    times = rows.column("times").combine_chunks().flatten().to_numpy()
    ends = np.cumsum(lengths)

    def added(values: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
        return pa.array(total[ends] - total[ends - lengths], pa.int64())

    columns = [rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    n_best, count_sum = added(np.where(best[place], times, 0) if len(place) else times), added(n[place] * times if len(place) else times)
    return pa.table([*columns, n_best, count_sum, rows.column("groups_sha256")], names=["doc_id", *(f.split()[0] for f in _RESULT.split(", "))])
