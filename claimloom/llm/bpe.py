"""Byte-level BPE over whole texts: overlapping chunks, stitched where pre-token boundaries agree.

The pre-token pattern never looks behind, so two scans of one text that have a boundary in common go on
alike from there. Texts up to ``CHUNK`` characters are scanned in one go. Longer ones are cut into chunks
that overlap, the chunks are dealt over the cluster and encoded apart, and each seam is closed at the
first boundary that both neighbours found and that the left one could see enough text to be sure of.
Where an overlap has no such boundary (one word longer than the overlap) the stretch is scanned again
over both chunks. Decoding joins the bytes of the tokens.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import with_id

CHUNK = 1 << 15
OVERLAP = 512
GUARD = 4
CACHE = 1 << 16
#: Characters of the texts whose new pieces are merged together; a text is never cut for it.
SLICE = 1 << 18
LONG_PIECE = 256
#: Longest piece that is remembered.
KEPT = 64

_SCHEMA = "ids array<int>, decoded binary"
_PART = "digest string, chunk int, start long, last boolean, text string"
_ENCODED = _PART + ", ends array<long>, cuts array<long>, ids array<int>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes with a table of ranks; a worker keeps one for all its tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = [array("i", [rank]).tobytes() for rank in range(len(self.bytes))]
        self.known = _Memory(self._piece)
        self.joins = Joins(ranks)

    def _piece(self, piece: str) -> bytes:
        """Ids as 32-bit numbers: a third of the room that a tuple of them takes."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return self.single[whole]
        return array("i", merged(raw, self.ranks) if len(raw) < LONG_PIECE else merged_long(raw, self.ranks)).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the pieces that are new in all of them are merged at once."""
        split = [self.pieces.findall(text) for text in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def _learn(self, pieces: set[str]) -> None:
        known, older = self.known, self.known.older
        new = [p for p in pieces if p not in known and p not in older and len(p) < KEPT]
        raws = [p.encode("utf-8", "surrogatepass") for p in new]
        whole = [self.ranks.get(raw) for raw in raws]
        merged = iter(self.joins.merged([raw for raw, rank in zip(raws, whole) if rank is None]))
        known.keep({p: next(merged) if rank is None else self.single[rank] for p, rank in zip(new, whole)})

    def encode_pieces(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ends of the pieces, the number of ids up to each end, and the ids."""
        pieces = self.pieces.findall(text)
        self._learn(set(pieces))
        ids = [self.known[p] for p in pieces]
        return list(accumulate(map(len, pieces))), list(accumulate(len(i) // 4 for i in ids)), array("i", b"".join(ids)).tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, array("i", ids)))


class _Memory(dict):
    """Results by argument in two generations of at most ``CACHE`` entries each, or as many as were added at once."""

    def __init__(self, compute):
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) < KEPT:
            self.keep({key: value})
        return value

    def keep(self, values: dict) -> None:
        if len(self) + len(values) > CACHE:
            self.older = dict(self)
            self.clear()
        self.update(values)


class Joins:
    """Merges many pieces together: in each round every piece joins its pair of lowest rank, the leftmost of equals."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = sorted(
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        )
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([r for _, r in pairs] + [self.NONE], np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, which is the id of the two as one; ``NONE`` for pairs that are no token."""
        key = left << 32 | right
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[place] == key, self.joined[place], self.NONE)

    def merged(self, raws: list[bytes]) -> list[bytes]:
        """What :func:`merged` gives for each piece, none of them empty, as 32-bit numbers."""
        out: list[bytes] = [b""] * len(raws)
        if not raws:
            return out
        ids = self.byte[np.frombuffer(b"".join(raws), np.uint8)]
        if (ids < 0).any():
            return [array("i", merged(raw, self.ranks)).tobytes() for raw in raws]
        number = np.arange(len(raws))  # of the pieces still in work
        size = np.array([len(raw) for raw in raws])
        starts = np.cumsum(size) - size
        rank = np.full(len(ids), self.NONE, np.int32)  # of each id with the one behind it
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[starts + size - 1] = self.NONE
        while True:
            low = np.minimum.reduceat(rank, starts)
            going = low != self.NONE
            if not going.all():
                flat = ids.astype(np.int32).tobytes()
                over = ~going
                for n, start, end in zip(number[over].tolist(), (starts[over] * 4).tolist(), ((starts + size)[over] * 4).tolist()):
                    out[n] = flat[start:end]
                if not going.any():
                    return out
                stay = np.repeat(going, size)
                ids, rank, number, size, low = ids[stay], rank[stay], number[going], size[going], low[going]
                starts = np.cumsum(size) - size
            found = np.flatnonzero(rank == np.repeat(low, size))
            at = found[np.searchsorted(found, starts)]
            ids[at] = low
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            rank[at] = rank[at + 1]  # NONE if the pair was the last of its piece
            ids, rank, size = ids[stay], rank[stay], size - 1
            at -= np.arange(len(at))
            inner = at[at > starts - np.arange(len(at))]
            starts = np.cumsum(size) - size
            behind = at[at + 1 < starts + size]
            rank[behind] = self._ranks(ids[behind], ids[behind + 1])
            rank[inner - 1] = self._ranks(ids[inner - 1], ids[inner])


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank."""
    none = 1 << 60
    parts = [raw[i : i + 1] for i in range(len(raw))]
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def merged_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for pieces of any length."""
    n = len(raw)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(raw[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop or not end[i]:
            continue
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : end[i]]])
        i = after[i]
    return out


def cut(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, bool, str]]:
    """(start, is it the last, text) of overlapping chunks."""
    for start in range(0, max(len(text), 1), size):
        yield start, start + size >= len(text), text[start : start + size + overlap]
        if start + size >= len(text):
            return


def stitched(parts: list[dict], codec: Codec) -> list[int]:
    """The ids of a whole text from its encoded chunks, in order."""
    ids: list[int] = []
    left, lead = None, 0  # the chunk being taken over, and how many of its ids are taken already
    for part in parts:
        right = part
        if left is not None:
            seam = _seam(left, right)
            if seam is None:
                known = max((e for e in _sure(left) if e >= left["from"]), default=left["from"])
                ids += left["ids"][lead : _ids_before(left, known)]
                text = left["text"][known - left["start"] :][: max(0, right["start"] - known)] + right["text"]
                if known > right["start"]:
                    text = right["text"][known - right["start"] :]
                ends, cuts, new = codec.encode_pieces(text)
                right = {"start": known, "last": right["last"], "text": text, "ends": [known + e for e in ends], "cuts": cuts, "ids": new}
                seam = known
            else:
                ids += left["ids"][lead : _ids_before(left, seam)]
            lead = _ids_before(right, seam)
            right = dict(right, **{"from": seam})
        else:
            right = dict(right, **{"from": right["start"]})
        left = right
    return ids + list(left["ids"][lead:]) if left else ids


def _sure(part: dict) -> list[int]:
    """Ends of pieces that what follows the chunk cannot change."""
    if part["last"]:
        return list(part["ends"])
    stop = part["start"] + len(part["text"]) - GUARD
    return [e for e in part["ends"] if e <= stop]


def _seam(left: dict, right: dict) -> int | None:
    found = {right["start"], *right["ends"]}
    low = max(right["start"], left["from"])
    return min((e for e in [left["from"], *_sure(left)] if e >= low and e in found), default=None)


def _ids_before(part: dict, boundary: int) -> int:
    if boundary <= part["start"]:
        return 0
    return part["cuts"][list(part["ends"]).index(boundary)]


def slices(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbours that hold at most ``most`` characters together; a longer text is alone."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total + size > most and i > first:
            yield first, i - first
            first, total = i, 0
        total += size
    if sizes:
        yield first, len(sizes) - first


_last: list = [None, None, None]


def _codec(shared, pattern: str) -> Codec:
    """The codec of the worker's last task, if it was for the same broadcast table and pattern."""
    if _last[0] is not shared or _last[1] != pattern:
        _last[:] = shared, pattern, Codec(shared.value, pattern)
    return _last[2]


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """doc_id, ids, decoded (bytes) for each row of ``docs``.

    Null texts are read as empty and have no ids. Repeated rows come out as often as they went in, and no
    other column is read, so names cannot clash. The ranks, a vocabulary of fixed size, are read on the
    driver and broadcast.
    """
    def schema(ddl: str):
        return with_id(docs, id_col, "doc_id", ddl)

    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for at, n in slices(pc.utf8_length(batch.column("text")).to_pylist()):
                part = batch.slice(at, n)
                yield _result(part.column("doc_id"), codec.encode_all(part.column("text").to_pylist()), codec)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for i in range(batch.num_rows):
                text, key = batch.column("text")[i].as_py(), batch.column("doc_id").slice(i, 1)
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                for n, (start, last, piece) in enumerate(cut(text, chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [key, pa.array([digest]), pa.array([n], pa.int32()), pa.array([start]), pa.array([last]), pa.array([piece])],
                        ["doc_id", "digest", "chunk", "start", "last", "text"],
                    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                start = row.column("start")[0].as_py()
                ends, cuts, ids = codec.encode_pieces(row.column("text")[0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([[start + e for e in ends]], pa.list_(pa.int64())), pa.array([cuts], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int32()))],
                    [*row.schema.names, "ends", "cuts", "ids"],
                )

    def close(group: pa.Table) -> pa.Table:
        codec = _codec(shared, pattern)
        parts = sorted(group.select(["chunk", "start", "last", "text", "ends", "cuts", "ids"]).to_pylist(), key=lambda p: p["chunk"])
        copies = sum(p["chunk"] == 0 for p in parts)
        ids = array("i", stitched([p for n, p in enumerate(parts) if n == 0 or parts[n - 1]["chunk"] != p["chunk"]], codec)).tobytes()
        key = group.column("doc_id").combine_chunks().slice(0, 1)
        return pa.Table.from_batches([_result(pa.concat_arrays([key] * copies), [ids] * copies, codec)])

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, schema(_SCHEMA))
    long = (
        rows.filter(F.length("text") > chunk)
        .mapInArrow(chunks, schema(_PART))
        .repartition("digest", "chunk")
        .mapInArrow(pieces, schema(_ENCODED))
        .groupBy("doc_id", "digest")
        .applyInArrow(close, schema(_SCHEMA))
    )
    return short.unionByName(long)


def _result(keys: pa.Array, ids: list[bytes], codec: Codec) -> pa.RecordBatch:
    decoded = pa.array([codec.decode(x) for x in ids], pa.binary())
    ends = pa.array([0, *accumulate(len(x) // 4 for x in ids)], pa.int32())
    flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, flat), decoded], ["doc_id", "ids", "decoded"])
