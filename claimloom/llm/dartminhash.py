"""Near-duplicate texts by DartMinHash over weighted five-word shingles.

A shingle that occurs w times is an element of weight w. Darts fall on the plane of weight and rank of each
element: every unit cell of it holds a Poisson number of darts, drawn from the hash of element and cell, and
each dart has a rank, a place on the weight axis and one of ``COORDINATES``. A text keeps, per coordinate,
the dart of lowest rank under its elements' weights. Two texts keep the same dart with a chance equal to
their weighted Jaccard similarity, the sum of smaller over the sum of larger weights. The ranks looked at
stop where about k ln k + 2k darts are in, so a signature costs about the text's length plus that number.

Signatures meet in ``BANDS`` bands. Texts with equal shingles are one class from the start. In each bucket
all classes are compared with its least one, exactly; what is then still apart in a bucket is compared in
blocks within tasks that put out a spanning forest of the links, never all pairs. Components of the links
are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.components import Forest, components, sized
from claimloom.llm.decontaminate import _FOLD
from claimloom.llm.hashing import batches, mix, word_hashes
from claimloom.sinks import scratch, stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
BLOCK = 256

_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, n + 1)) for n in range(0, 12)])
_STEPS = [np.uint64(c) for c in (0x8CB92BA72F3D8DD7, 0xA3EC647659359ACD, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Hashed shingles of each text in order; fewer words than a shingle has are one shingle."""
    out: list[np.ndarray] = []
    for first, last in batches(texts):
        words, offsets = word_hashes([t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts[first:last]])
        n = len(words)
        padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
        total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k, step in enumerate(_STEPS):
                total += padded[k : k + n] * step
            total = mix(total)
            for a, b in zip(offsets[:-1], offsets[1:]):
                if b - a >= SHINGLE:
                    out.append(total[a : b - SHINGLE + 1])
                elif b > a:
                    own = np.concatenate([words[a:b], np.zeros(SHINGLE - (b - a), np.uint64)])
                    out.append(mix(np.array([sum(int(w) * int(s) for w, s in zip(own, _STEPS)) & (2**64 - 1)], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def weighted(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, counts = np.unique(elements, return_counts=True)
    return distinct, counts.astype(np.float64)


def cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit cells on the weight axis that each element reaches, and how full each is."""
    many = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    with np.errstate(over="ignore"):
        hashed = mix(elements[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashed, np.minimum(weights[owner] - place, 1.0)


def signature(hashed: np.ndarray, full: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate; ``hashed`` must not be empty."""
    reach = (k * np.log(k) + 2 * k) / full.sum()
    out = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        while True:
            ranks, darts = [], []
            height = int(np.ceil(reach))
            step = max(1, (1 << 18) // len(hashed))
            for low in range(0, height, step):
                rows = np.arange(low, min(low + step, height), dtype=np.uint64)
                spots = mix((hashed[:, None] + (rows + np.uint64(1))[None, :] * np.uint64(0xD1B54A32D192ED03)).ravel())
                counts = np.searchsorted(_POISSON, (spots >> np.uint64(11)) * 2.0**-53, "right")
                owner = np.repeat(np.arange(len(spots)), counts)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                dart = mix(spots[owner] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8BB84B93962EACC9))
                rank = rows[owner % len(rows)].astype(np.float64) + (dart >> np.uint64(11)) * 2.0**-53
                place = (mix(dart ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)) * 2.0**-53
                inside = (rank < reach) & (place < full[owner // len(rows)])
                ranks.append(rank[inside])
                darts.append(dart[inside])
            rank, dart = np.concatenate(ranks), np.concatenate(darts)
            value = mix(dart ^ np.uint64(0x5851F42D4C957F2D))
            coordinate = (value % np.uint64(k)).astype(np.int64)
            late_first = np.argsort(-rank, kind="stable")
            seen = np.zeros(k, bool)
            seen[coordinate] = True
            if seen.all():
                out[coordinate[late_first]] = value[late_first]
                return out
            reach *= 2


def band_hashes(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return total.view(np.int64)


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, made = [], []
    for i, elements in enumerate(shingles(batch.column("text").to_pylist())):
        if len(elements):
            hashed, full = cells(*weighted(elements))
            with np.errstate(over="ignore"):
                twice = mix(hashed ^ np.uint64(0x94D049BB133111EB))
                digest = f"{int(hashed.sum()):016x}{int(twice.sum()):016x}{len(hashed)}"
            ids.append(i)
            made.append((digest, band_hashes(signature(hashed, full))))
    picked = batch.column("node").take(pa.array(ids, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [picked, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int64()))],
        ["node", "digest", "bands"],
    )


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays of distinct cells."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sliced(batches_: Iterator[pa.RecordBatch], one) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        for at in range(0, batch.num_rows, 256):
            yield one(batch.slice(at, 256))


def _cells_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [np.sort(cells(*weighted(e))[0]).view(np.int64) for e in shingles(batch.column("text").to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "cells"])


def _block_links(group: pa.Table) -> pa.Table:
    """A spanning forest of the links between the two blocks of a group, past what is connected already."""
    rows = group.select(["node", "component", "side", "cells"]).to_pydict()
    cells_ = [np.sort(np.array(c, np.int64).view(np.uint64)) for c in rows["cells"]]
    node, component, side = rows["node"], rows["component"], rows["side"]
    names = {c: n for n, c in enumerate(sorted(set(component)))}
    forest, a, b = Forest(len(names)), [], []
    order = sorted(range(len(node)), key=lambda i: len(cells_[i]))
    for p, i in enumerate(order):
        for j in order[p + 1 :]:
            if len(cells_[i]) < SIMILARITY * len(cells_[j]):
                break
            if side[i] == 2 or side[j] == 2 or side[i] != side[j]:
                x, y = names[component[i]], names[component[j]]
                if forest.root(x) != forest.root(y) and similarity(cells_[i], cells_[j]) >= SIMILARITY:
                    forest.join(x, y)
                    a.append(node[i])
                    b.append(node[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept for every row of ``docs``.

    ``class_id`` is the least id that links of weighted Jaccard ``SIMILARITY`` and above reach, and ``kept``
    marks its row. Texts without a word (null and empty ones too) and rows without an id link with nothing:
    the former have their own id as class, the latter none, and both are kept. Rows that share an id are one
    document with several texts. Whole texts are read; ids must be whole numbers; other columns are not read.
    """
    with scratch(docs.sparkSession):
        total = _linked(docs, id_col, text_col)
    named_rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("long").alias("node"))
    return named_rows.join(total, "node", "left").select(
        "doc_id",
        F.coalesce("component", "node").alias("class_id"),
        (F.col("node").isNull() | (F.coalesce("component", "node") == F.col("node"))).alias("kept"),
    )


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, component of every document with a word; all stages but the result go when it is written."""
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.filter(F.col("node").isNotNull())
    signed = stage(
        named.mapInArrow(lambda b: _sliced(b, _signed), "node long, digest string, bands array<long>"), "dart-signatures"
    )
    classes = stage(signed.groupBy("digest").agg(F.min("node").alias("least"), F.min_by("bands", "node").alias("bands")), "dart-classes")
    equal = signed.join(classes.select("digest", "least"), "digest").select(F.col("node").alias("a"), F.col("least").alias("b"))
    banded = stage(classes.select("least", F.explode("bands").alias("key")), "dart-bands")
    buckets = stage(
        banded.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("center"), F.sum(F.xxhash64("least").cast("decimal(38,0)")).alias("members"))
        .filter("n > 1"),
        "dart-buckets",
    )
    shared = stage(banded.join(buckets.select("key", "center"), "key"), "dart-members")
    pairs = stage(
        shared.filter("least != center").select(F.col("center").alias("a"), F.col("least").alias("b")).distinct(), "dart-pairs"
    )
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "dart-wanted")
    held = stage(
        named.join(sized(wanted), "node").mapInArrow(lambda b: _sliced(b, _cells_of), "node long, cells array<long>"), "dart-cells"
    )
    left, right = held.select(F.col("node").alias("a"), F.col("cells").alias("x")), held.select(F.col("node").alias("b"), F.col("cells").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    close = both >= SIMILARITY * (F.size("x") + F.size("y") - both)
    fits = F.least(F.size("x"), F.size("y")) >= SIMILARITY * F.greatest(F.size("x"), F.size("y"))
    starred = stage(pairs.join(left, "a").join(right, "b").filter(fits & close).select("a", "b"), "dart-links")
    first = components(starred)

    # Buckets whose members are still in several components, each set of members once.
    label = F.coalesce("component", "least")
    placed = shared.join(first, shared["least"] == first["node"], "left").select("key", "least", label.alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
    open_ = open_.join(buckets.select("key", "members"), "key").groupBy("members", "n").agg(F.min("key").alias("key"))
    open_ = stage(open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "dart-open")
    members = placed.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("least"), F.col("blocks")).cast("int"))
    # A row of block i meets blocks 0 to blocks - 1; side tells the two apart, 2 is a block with itself.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("other", other).select(
        "key",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        F.col("least").alias("node"),
        "component",
    )
    found = stage(dealt.join(held, "node").groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long"), "dart-more-links")
    return stage(components(equal.unionByName(starred).unionByName(found)), "dart-groups", keep=True)
