"""Centroid clustering of vectors with heap-ordered bounds, exact in whole numbers.

Vectors lie in blocks, a row each. A block keeps for every cluster a heap of its vectors, ordered by the gap
between a vector's distance to its second nearest and to its own centroid when it was last looked at. Each
round the centroids drift: a gap shrinks by at most the drift of the own centroid plus the largest drift of
the others. What a cluster's gaps have lost so far is one number, so keys are stored with the number of their
time added, and a gap has expired when its key is not above the number of now. Only expired vectors are popped
and compared with every centroid; all others surely stay. The sums of a cluster change by the vectors that
moved, and whole numbers make them exact in any order.

A round is one narrow pass over the blocks, written to the shared folder, and one small aggregate of what
moved. Centroids, counts and sums (k times the dimension, both parameters) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.sinks import delete, shared_folder, stage

#: Bytes of the vectors of one block.
BLOCK_BYTES = 1 << 22
#: Components are held within this bound, so that squared distances of up to 2**9 of them fit a long.
BOUND = 1 << 26
#: Sums of products of whole numbers up to this are exact in double precision.
EXACT = 1 << 21

_STATE = "data binary, cluster binary, keys binary, heap binary, moved array<long>"


def squared(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered vectors and centers, as a table."""
    high = max(np.abs(vectors).max(initial=0), np.abs(centers).max(initial=0))
    if high <= EXACT and vectors.shape[1] <= 1 << 9:
        x, c = vectors.astype(np.float64), centers.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    wide = vectors.astype(np.int64)
    return np.stack([((wide - c) ** 2).sum(axis=1) for c in centers.astype(np.int64)], axis=1)


class Bounds:
    """Clusters of the vectors of a block and, for each cluster, the heap of its gaps."""

    def __init__(self, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.cluster, self.heaps = cluster, heaps

    @classmethod
    def load(cls, k: int, cluster: bytes, keys: bytes, heap: bytes) -> Bounds:
        order, key = np.frombuffer(heap, np.int32), np.frombuffer(keys, np.float64)
        ends = np.cumsum(order[:k])
        order = order[k:]
        found = [list(zip(key[b - n : b].tolist(), order[b - n : b].tolist())) for n, b in zip(np.diff(ends, prepend=0), ends)]
        return cls(np.frombuffer(cluster, np.int32).copy(), found)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        entries = [e for h in self.heaps for e in h]
        keys = np.array([e[0] for e in entries], np.float64)
        heap = np.array([*map(len, self.heaps), *(e[1] for e in entries)], np.int32)
        return self.cluster.tobytes(), keys.tobytes(), heap.tobytes()

    def advance(self, vectors: np.ndarray, centers: np.ndarray, lost: np.ndarray) -> int:
        """Pop what has expired and rescan it against ``centers``; returns how many vectors that were.

        ``lost`` is, for each cluster, what its gaps have lost since the start.
        """
        expired: list[int] = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= lost[c]:
                expired.append(heapq.heappop(heap)[1])
        popped = np.array(expired, np.int64)
        for at in range(0, len(popped), 4096):
            some = popped[at : at + 4096]
            far = squared(vectors[some], centers)
            near = far.argmin(axis=1)  # the smaller number of equals
            own = np.sqrt(far[np.arange(len(some)), near].astype(np.float64))
            far[np.arange(len(some)), near] = np.iinfo(np.int64).max
            second = np.sqrt(far.min(axis=1).astype(np.float64)) if far.shape[1] > 1 else np.full(len(some), np.inf)
            # A little less than the gap: rounding must never keep a vector that should be looked at.
            gap = (second - own) - 1e-9 * (1 + own + np.where(np.isinf(second), 0, second))
            for i, c, key in zip(some.tolist(), near.tolist(), (gap + lost[near]).tolist()):
                heapq.heappush(self.heaps[c], (key, i))
            self.cluster[some] = near
        return len(popped)


def _moved(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[int]:
    """Changes of the count and the sums of each cluster, flat."""
    out = np.zeros((k, vectors.shape[1] + 1), np.int64)
    changed = np.flatnonzero(before != after)
    for sign, place in ((-1, before), (1, after)):
        for c in np.unique(place[changed]):
            own = changed[place[changed] == c]
            if c >= 0:
                out[c, 0] += sign * len(own)
                out[c, 1:] += sign * vectors[own].astype(np.int64).sum(axis=0)
    return out.ravel().tolist()


def whole_numbers(vectors: DataFrame, dimension: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: kept vectors as whole numbers floor(scale * x), held within ``BOUND``."""
    kept = (F.size(vector_col) == dimension) & ~F.exists(
        vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    held = lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(-BOUND)), F.lit(BOUND)).cast("int")
    return vectors.filter(kept).select(F.col(id_col).alias("vec_id"), F.transform(vector_col, held).alias("v"))


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimension: int = 64, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept row of ``vectors``.

    Vectors that are null, of another length than ``dimension``, or hold null or non-finite components are left
    out. The k rows of smallest sha256 of ``seed:vec_id`` start as centroids (rows without an id come last; rows
    of one id by their components); with fewer rows, all of them. Equal distances go to the smaller number, an
    empty cluster stays where it is. Repeated rows count and come out each, an empty table gives no rows, other
    columns are not read. Components beyond 2**26 after scaling are held there.
    """
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, dimension, scale, id_col, vector_col)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = numbers.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centers = np.array([r["v"] for r in first], np.int64).reshape(-1, dimension)
    k = len(centers)
    ids = T.StructField("ids", T.ArrayType(vectors.schema[id_col].dataType))
    blocked = T.StructType([*T.StructType.fromDDL(_STATE).fields, ids])
    counts, sums, lost = [0] * k, np.zeros((k, dimension), object), np.zeros(k)
    state, path = numbers.mapInArrow(_blocks(k, max(1, block_bytes // (4 * dimension)), blocked.fieldNames()), blocked), None
    for turn in range(rounds if k else 0):
        before, path = path, f"{shared_folder(spark)}/stage/cluster-{turn}-{uuid.uuid4().hex}"
        state.mapInArrow(_round(centers, lost, dimension), blocked).write.parquet(path)
        if before:
            delete(spark, before)
        state = spark.read.schema(blocked).parquet(path)
        changes = state.select(F.posexplode("moved")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("n"))
        for r in changes.filter("n != 0").collect():
            c, place = divmod(r["pos"], dimension + 1)
            if place:
                sums[c, place - 1] += int(r["n"])
            else:
                counts[c] += int(r["n"])
        new = np.array([[s // n for s in sums[c]] if (n := counts[c]) else centers[c] for c in range(k)], np.int64)
        drift = np.array([float(sum(int(d) ** 2 for d in row)) for row in new - centers]) ** 0.5
        others = np.array([np.delete(drift, c).max(initial=0) for c in range(k)])
        lost, centers = (lost + drift + others) * (1 + 1e-12), new
    id_field = T.StructField("vec_id", ids.dataType.elementType)
    schema = T.StructType([id_field, *T.StructType.fromDDL("cluster int, distance long").fields])
    placed = stage(state.mapInArrow(_last_round(centers, lost, dimension), schema), "clustered")
    if path:
        delete(spark, path)
    # k rows of numbers: a broadcast bounded by a parameter.
    inertia = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    total = sum(inertia.values())
    named = [
        (c, inertia.get(c, 0), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centers.tolist())
    ]
    described = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(described), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _blocks(k: int, per_block: int, names: list[str]):
    """Blocks of vectors in which every vector waits to be looked at."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                waiting = [[(-np.inf, i) for i in range(part.num_rows)], *([] for _ in range(k - 1))]
                bounds = Bounds(np.full(part.num_rows, -1, np.int32), waiting)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                data = part.column("v").flatten().to_numpy().astype(np.int32).tobytes()
                yield _row(data, bounds, [], ids, names)

    return apply


def _row(data: bytes, bounds: Bounds, moved: list[int], ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    binary = [pa.array([b], pa.binary()) for b in (data, *bounds.dump())]
    return pa.RecordBatch.from_arrays([*binary, pa.array([moved], pa.list_(pa.int64())), ids], names)


def _opened(batches: Iterator[pa.RecordBatch], k: int, dimension: int) -> Iterator[tuple[np.ndarray, Bounds, pa.RecordBatch]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            data, *kept = (row.column(c)[0].as_py() for c in ("data", "cluster", "keys", "heap"))
            yield np.frombuffer(data, np.int32).reshape(-1, dimension), Bounds.load(k, *kept), row


def _round(centers: np.ndarray, lost: np.ndarray, dimension: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vectors, bounds, row in _opened(batches, len(centers), dimension):
            before = bounds.cluster.copy()
            bounds.advance(vectors, centers, lost)
            moved = _moved(vectors, before, bounds.cluster, len(centers))
            yield _row(row.column("data")[0].as_py(), bounds, moved, row.column("ids"), row.schema.names)

    return apply


def _last_round(centers: np.ndarray, lost: np.ndarray, dimension: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vectors, bounds, row in _opened(batches, len(centers), dimension):
            bounds.advance(vectors, centers, lost)
            distance = ((vectors.astype(np.int64) - centers[bounds.cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [row.column("ids").flatten(), pa.array(bounds.cluster, pa.int32()), pa.array(distance, pa.int64())],
                ["vec_id", "cluster", "distance"],
            )

    return apply
