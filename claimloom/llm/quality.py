"""Text quality with a factorisation machine.

Features are hashed words, bucketed statistics of a text's structure and bucketed numeric metadata. Each
feature i has a weight w_i and a short vector v_i; a text scores

    w_0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

which is every pairwise interaction of its features, in time linear in their number. The fit uses at most
``TRAIN_ROWS`` labelled documents of each class, those of lowest hash, weighted back to the class counts.
Scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import beside

TRAIN_ROWS = 4000
KEEP_AT = 0.7
BUCKETS = 1 << 16
FACTORS = 8
#: Gradient steps of a fit, each on BATCH documents; a small sample is gone over more often.
STEPS = 400
BATCH = 128

#: Edges of the buckets for shares and for sizes.
SHARES = np.array([0, 1e-3, 3e-3, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
SIZES = np.array([2.0**k for k in range(0, 24)])
STATS = (
    "upper", "digit", "mark", "space", "wide", "bars", "shouts", "signs", "distinct words", "commonest word",
    "repeats", "distinct lines", "word length", "line length", "bytes", "words",
)
WIDTH = 32


def statistics(text: str) -> tuple[list[float], list[float], Counter]:
    """Shares, sizes and the words of a text, in the order of ``STATS``."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, wide = int(histogram[65:91].sum()), int(histogram[48:58].sum()), int(histogram[128:].sum())
    lower, space = int(histogram[97:123].sum()), int(histogram[[9, 10, 13, 32]].sum())
    words = text.split()
    lines = text.split("\n")
    counts = Counter(words)
    many = max(len(words), 1)
    letters = max(upper + lower, 1)
    shares = [
        upper / letters,
        digit / n,
        (int(histogram[33:127].sum()) - upper - lower - digit) / n,
        space / n,
        wide / n,
        histogram[124] / n,
        histogram[33] / n,
        int(histogram[[35, 36, 37, 38, 42, 64, 94, 126]].sum()) / n,
        len(counts) / many,
        max(counts.values(), default=0) / many,
        sum(map(eq, words, words[1:])) / many,
        len(set(lines)) / len(lines),
    ]
    return shares, [(n - space) / many, n / len(lines), len(raw), len(words)], counts


class Features:
    """Sparse features of texts; remembers the buckets of words met lately."""

    def __init__(self, metadata: int):
        self.base = (len(STATS) + metadata) * WIDTH
        self.size = self.base + BUCKETS
        self.bucket: dict[str, int] = {}

    def _word(self, word: str) -> int:
        found = self.bucket.get(word)
        if found is None:
            found = self.base + zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
            if len(self.bucket) >= 1 << 17:
                self.bucket.clear()
            if len(word) < 64:
                self.bucket[word] = found
        return found

    def of(self, text: str, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray]:
        shares, sizes, counts = statistics(text)
        fixed = np.concatenate([np.searchsorted(SHARES, shares, "left"), np.searchsorted(SIZES, sizes, "right")])
        extra = [WIDTH - 1 if m is None or m != m else int(np.searchsorted(SIZES, m, "right")) for m in metadata]
        slots = np.arange(len(fixed) + len(extra)) * WIDTH + np.concatenate([fixed, extra]).astype(np.int64)
        words = np.fromiter(map(self._word, counts), np.int64, len(counts))
        weight = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        weight /= max(float(np.sqrt((weight * weight).sum())), 1e-9)
        return np.concatenate([slots, words]), np.concatenate([np.full(len(slots), 0.5, np.float32), weight])


class Machine:
    """Weights of a factorisation machine and its scoring by the sum-of-squares identity."""

    def __init__(self, size: int, factors: int = FACTORS, seed: int = 5):
        self.bias = 0.0
        self.weights = np.zeros(size, np.float32)
        self.vectors = (np.random.default_rng(seed).standard_normal((size, factors)) * 0.02).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each text's summed vectors. Every text has a feature at least."""
        scaled = self.vectors[index] * value[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat(scaled * scaled, starts, axis=0)
        linear = np.add.reduceat(self.weights[index] * value, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, starts)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> None:
        """Adaptive gradient steps on the weighted log loss."""
        rate, decay = 0.1, 1e-5
        linear, curved, bias = np.full(len(self.weights), 1e-6, np.float32), np.full(self.vectors.shape, 1e-6, np.float32), 1e-6
        order = np.random.default_rng(11)
        share = float((labels * weights).sum() / weights.sum())
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        for _ in range(-(-STEPS * BATCH // len(rows))):
            shuffled = order.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                chosen = shuffled[at : at + BATCH]
                index = np.concatenate([rows[i][0] for i in chosen])
                value = np.concatenate([rows[i][1] for i in chosen]).astype(np.float32)
                counts = np.array([len(rows[i][0]) for i in chosen])
                raw, sums = self.raw(index, value, np.concatenate([[0], np.cumsum(counts)[:-1]]))
                error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) * weights[chosen]).astype(np.float32) / len(chosen)
                each = np.repeat(error, counts) * value
                pull = each[:, None] * (np.repeat(sums, counts, axis=0) - self.vectors[index] * value[:, None])
                distinct, place = np.unique(index, return_inverse=True)
                step = np.bincount(place, each, len(distinct)).astype(np.float32) + decay * self.weights[distinct]
                linear[distinct] += step * step
                self.weights[distinct] -= rate * step / np.sqrt(linear[distinct])
                steps = np.stack([np.bincount(place, pull[:, f], len(distinct)) for f in range(pull.shape[1])], axis=1).astype(np.float32)
                steps += decay * self.vectors[distinct]
                curved[distinct] += steps * steps
                self.vectors[distinct] -= 0.3 * rate * steps / np.sqrt(curved[distinct])
                whole = float(error.sum())
                bias += whole * whole
                self.bias -= rate * whole / bias**0.5


def _rows(docs: DataFrame, id_col: str, text_col: str, metadata: Sequence[str]) -> DataFrame:
    numbers = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *numbers)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata: Sequence[str] = (), bound: int = TRAIN_ROWS,
) -> Machine:
    """A machine fitted on at most ``bound`` labelled documents of each class.

    Ids with several labels count as 1 only if all are 1; null labels and ids do not count. Without any
    labelled document every text scores near 1: nothing is known against it.
    """
    features = Features(len(metadata))
    machine = Machine(features.size)
    known = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 1).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("label") == c).orderBy("order", "doc_id").limit(bound) for c in (0, 1)]
    # Two rows of numbers for each id at most 2 * bound ids: a broadcast of known size.
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows = _rows(docs, id_col, text_col, metadata).join(sample, "doc_id")
    count = len(metadata)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features(count)
        for batch in batches:
            numbers = [batch.column(f"m{i}").to_pylist() for i in range(count)]
            texts = batch.column("text").to_pylist()
            made = [maker.of(t or "", [n[i] for n in numbers]) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("label"), pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))],
                ["order", "label", "index", "value"],
            )

    found = (
        rows.mapInArrow(extract, "order long, label int, index array<int>, value array<float>")
        .orderBy("order").limit(2 * bound).toArrow().sort_by("order")
    )
    if found.num_rows == 0:
        machine.bias = 20.0
        return machine
    label = found.column("label").to_numpy()
    index, value = found.column("index").combine_chunks(), found.column("value").combine_chunks()
    pairs = [(index[i].values.to_numpy().astype(np.int64), value[i].values.to_numpy()) for i in range(len(label))]
    share = {c: sizes.get(c, 0) / max(1, int((label == c).sum())) for c in (0, 1)}
    weights = np.where(label == 1, share[1], share[0]).astype(np.float32)
    machine.fit(pairs, label.astype(np.float32), weights / weights.mean())
    return machine


def with_score(
    docs: DataFrame, machine: Machine, name: str = "score", text_col: str = "text", metadata: Sequence[str] = ()
) -> DataFrame:
    """``docs`` and the score (0 to 1) of each row as column ``name``.

    Null and empty texts are scored by the statistics of an empty text; null metadata has a bucket of its
    own. Rows stay as they are, repeated ones too; an empty table stays empty; ``name`` must be free.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    count = len(metadata)

    def work(texts: list, *others: list) -> pa.Array:
        maker, model = _maker(count), shared.value
        made = [maker.of(t or "", m) for t, *m in zip(texts, *others[:count])]
        if not made:
            return pa.array([], pa.float64())
        starts = np.concatenate([[0], np.cumsum([len(m[0]) for m in made])[:-1]])
        return pa.array(model.score(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), starts))

    numbers = [F.col(f"`{c}`").cast("double") for c in metadata]
    return beside(docs, work, "double", [F.col(f"`{text_col}`"), *numbers], name)


_makers: dict[int, Features] = {}


def _maker(count: int) -> Features:
    """The features of the worker's last task with as many metadata columns."""
    if count not in _makers:
        _makers.clear()
        _makers[count] = Features(count)
    return _makers[count]


def score(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = ()
) -> DataFrame:
    """doc_id and score of each row of ``docs``, as :func:`with_score` has it; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(metadata)])
    return with_score(rows, machine, "score", "text", [f"m{i}" for i in range(len(metadata))]).select("doc_id", "score")
