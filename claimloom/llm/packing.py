"""Sequences of a fixed number of tokens by hierarchical residual packing.

Every partition encodes its documents and packs their pieces by best fit, longest first. Sequences with at
least ``NEAR`` places left are then items themselves: they are dealt into fewer groups and packed by best fit
again, round after round, until one group holds what is left or rounds stop to save anything. Only the
numbers of a sequence travel in those rounds, a group has at most about ``GROUP`` of them, and the pieces
learn their final place from a join by sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.components import sized
from claimloom.llm.units import ByteLevel, Memory, glued
from claimloom.sinks import scratch, stage

CAPACITY = 2048
NEAR = 16
GROUP = 1 << 17
END_ID = 0
WIDTH = 4  # bytes of an id

_PIECE = "piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """The bin and the place of each item, and the fill of each bin. Ties: the earlier item, the latest bin."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    rooms = 0  # bit r: some bin has room r
    bins, places, fills = [0] * len(sizes), [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        enough = rooms >> size
        if enough and size < capacity:
            room = size + (enough & -enough).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            waiting[left].append(b)
            rooms |= 1 << left
    return bins, places, fills


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: only the first may be short."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


class Encoder:
    """The ids of whole texts as bytes; one for all batches of a task."""

    def __init__(self, vocabulary: str):
        self.level = ByteLevel(vocabulary, plain_specials=False)
        self.known = Memory(self.level.encode_units, self.level.starts_unit)

    def of(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        out = []
        for own, found in zip(parts, self.known.of([p[1:] for p in parts])):
            if None in found:
                own = glued(own, self.level.starts_unit)
                found = self.level.encode_units(own[1:])
            out.append(b"".join([self.level.encode(own[0]), *found]))
        return out


_last: list = [None, None]


def _encoder(shared) -> Encoder:
    """The encoder of the worker's last task, if it was for the same broadcast vocabulary."""
    if _last[0] is not shared:
        _last[:] = shared, Encoder(shared.value)
    return _last[1]


def pack(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, near: int = NEAR, group: int = GROUP, with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of ``docs``.

    A document is the ids of its text, as ``tokenizers`` gives them, and ``end_id``; null and empty texts are that
    id alone. Only documents over ``capacity`` ids are cut, and only their first piece may be short. Repeated
    rows and rows without an id are packed each; an empty table gives no rows; other columns are not read, so
    their names cannot clash. Equal sizes go in the order of the table. ``with_ids`` adds the ids themselves.
    A task holds at most ``group`` pieces besides one batch of texts.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = T.StructType.fromDDL(_PIECE + (", ids binary" if with_ids else "")).fields
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *fields])
    names = schema.fieldNames()
    end = end_id.to_bytes(WIDTH, "little")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple]]]:
        """Id column and pieces, (row, piece, start, length, crc32, ids) each, of a slice of texts."""
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, made = batch.slice(at, 256), []
                for row, ids in enumerate(encoder.of(part.column("text").to_pylist())):
                    ids += end
                    for n, (start, length) in enumerate(cuts(len(ids) // WIDTH, capacity)):
                        own = ids[start * WIDTH : (start + length) * WIDTH]
                        made.append((row, n, start, length, zlib.crc32(own), own if with_ids else None))
                yield part.column("doc_id"), made

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        keys, held = [], []

        def packed() -> pa.RecordBatch:
            nonlocal number
            bins, places, fills = best_fit([p[3] for p in held], capacity)
            fill = [fills[b] if place == 0 else None for b, place in zip(bins, places)]
            columns = [*zip(*held)][1:5] if held else [[], [], [], []]
            out = [pa.concat_arrays(keys), *columns, [number + b for b in bins], places, fill, *([[p[5] for p in held]] if with_ids else [])]
            number += len(fills)
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(out, kinds)], names)

        kinds = [None, pa.int32(), *[pa.int64()] * 6, pa.binary()]
        for column, made in encoded(batches):
            if len(held) + len(made) > group and held:
                yield packed()
                keys, held = [], []
            keys.append(column.take(pa.array([p[0] for p in made], pa.int64())))
            held += made
        if held:
            yield packed()

    pieces = stage(rows.mapInArrow(local, schema), "packed-pieces", keep=True)
    with scratch(spark):
        moved = _merged(pieces.filter(F.col("fill") <= capacity - near).select("bin", "fill"), capacity, near, group)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return pieces.join(sized(moved), "bin", "left").select(
        *kept,
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def _merged(bins: DataFrame, capacity: int, near: int, group: int) -> DataFrame:
    """bin, into, shift: where each sequence went that has become part of another one."""

    def again(items: pa.Table) -> pa.Table:
        items = items.sort_by("bin")
        names, sizes = items.column("bin").to_pylist(), items.column("fill").to_pylist()
        into, places, fills = best_fit(sizes, capacity)
        first = {b: name for b, name, place in zip(into, names, places) if place == 0}
        fill = [fills[b] if place == 0 else None for b, place in zip(into, places)]
        return pa.table([names, [first[b] for b in into], places, fill], names=["bin", "into", "shift", "fill"]).cast(
            pa.schema([(c, pa.int64()) for c in ("bin", "into", "shift", "fill")])
        )

    open_ = stage(bins, "open-sequences")
    moved, left, turn = None, open_.count(), 0
    while left > 1:
        groups = -(-left // group)
        dealt = open_.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        packed = stage(dealt.groupBy("group").applyInArrow(again, "bin long, into long, shift long, fill long"), "packed-sequences")
        step = packed.filter("bin != into").select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:
            further = step.select(F.col("bin").alias("into"), F.col("into").alias("top"), F.col("shift").alias("more"))
            onward = moved.join(sized(further), "into", "left").select(
                "bin", F.coalesce("top", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
            moved = stage(onward.unionByName(step), "moved-sequences")
        open_ = packed.filter(F.col("fill") <= capacity - near).select("bin", "fill")
        before, left, turn = left, open_.count(), turn + 1
        if groups == 1 or left > 0.99 * before:
            break
    if moved is None:
        return bins.sparkSession.createDataFrame([], "bin long, into long, shift long")
    return stage(moved, "moved", keep=True)
