"""Exact quantiles from two passes: a mergeable sketch that brackets the ranks, then exact counts in the brackets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the sketch, and how far on either side of a rank its bracket reaches, as a share of the rows: about
#: twice the error that the sketch keeps with 99 % certainty. A rank outside its bracket is noticed and looked for
#: among all values.
SKETCH = 2048
MARGIN = 0.003
#: Counted values that may come to the driver; brackets that hold more are cut into steps first.
COLLECTED = 1 << 17
BUCKETS = 4096

Interval = tuple[float, float]


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The least value at or below which at least each share of the rows lies; None without rows.

    NULL and NaN are no values. Infinities are the least and the greatest ones. ``df`` is read twice up to some
    tens of millions of rows; beyond, each further pass cuts what is open into ``BUCKETS`` steps. No pass sends
    more than ``COLLECTED`` rows to the driver, and nothing is stored.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    least, rows, n, low, high, sketch = values.agg(
        F.count_if(F.col("v") == float("-inf")), F.count("*"), F.count(finite), F.min(finite), F.max(finite), F.kll_sketch_agg_double(finite, SKETCH)
    ).first()
    ranks = [max(1, math.ceil(Decimal(str(s)) * rows)) for s in shares]
    if low is None:
        return [None if not rows else float("-inf") if r <= least else float("inf") for r in ranks]
    values = values.where(finite.isNotNull())
    inner = [r - least for r in ranks]
    asked = [min(1.0, max(0.0, r / n + side)) for r in inner for side in (-MARGIN, MARGIN)]
    where = {"sketch": F.lit(sketch), "asked": F.array(*map(F.lit, asked))}
    edges = df.sparkSession.sql("SELECT kll_sketch_get_quantile_double(:sketch, :asked)", args=where).first()[0]
    brackets = [(low if r / n < MARGIN else a, high if r / n > 1 - MARGIN else b) for r, a, b in zip(inner, edges[::2], edges[1::2])]
    found = {r: None for r in inner if 1 <= r <= n}
    wanted = {r: b for r, b in zip(inner, brackets) if r in found}
    if len(set(wanted.values())) * 2 * MARGIN * n <= COLLECTED:
        found.update(_counted(values, wanted))
    for r, interval in wanted.items():
        if found[r] is None:
            found[r] = _refined(values, r, interval, (low, high))
    return [found[r] if r in found else float("-inf") if r < 1 else float("inf") for r in inner]


def _counted(values: DataFrame, wanted: dict[int, Interval]) -> dict[int, float]:
    """The values of those ranks that lie in their brackets, by counting every value of the brackets."""
    intervals = sorted(set(wanted.values()))
    place = [F.struct(F.lit(k).alias("k"), F.when(F.col("v") >= a, F.col("v")).alias("v")) for k, (a, _) in enumerate(intervals)]
    places = F.array_compact(F.array(*(F.when(F.col("v") <= b, p) for p, (_, b) in zip(place, intervals))))
    counts: dict[int, list[tuple[float | None, int]]] = {}
    for r in values.select(F.inline(places)).groupBy("k", "v").agg(F.count("*").alias("n")).orderBy("k", F.col("v").asc_nulls_first()).collect():
        counts.setdefault(r["k"], []).append((r["v"], r["n"]))
    out = {}
    for rank, interval in wanted.items():
        reached = 0
        for v, n in counts.get(intervals.index(interval), ()):
            if v is None and n >= rank:
                break
            reached += n
            if v is not None and reached >= rank:
                out[rank] = v
                break
    return out


def _refined(values: DataFrame, rank: int, interval: Interval, whole: Interval) -> float:
    """The value of a rank by ever smaller steps, beginning with its bracket."""
    counted = values.select("v", F.lit(1).alias("n"))
    below = values.agg(F.count_if(F.col("v") < interval[0])).first()[0]
    (low, high), found = interval, False
    while True:
        for least, greatest, n in histogram(counted, [(low, high)]).get((low, high), ()):
            if below < rank <= below + n:
                low, high, found = least, greatest, True
                break
            below += n
        if not found:
            (low, high), below, found = whole, 0, True
        elif low == high:
            return low


def histogram(counted: DataFrame, intervals: list[Interval]) -> dict[Interval, list[tuple[float, float, int]]]:
    """(least, greatest, rows) of each filled step of the intervals, in order."""
    def step(k: int, low: float, high: float):
        # Halves, so that no difference leaves the range of a double.
        width = high / 2 - low / 2
        place = (F.col("v") / 2 - F.lit(low / 2)) / F.lit(width or 1.0) * BUCKETS
        return F.when(F.col("v").between(low, high), F.struct(F.lit(k).alias("k"), F.least(F.floor(place), F.lit(BUCKETS - 1)).alias("b")))

    places = F.array_compact(F.array(*(step(k, *interval) for k, interval in enumerate(intervals))))
    rows = (
        counted.select("v", "n", F.inline(places)).groupBy("k", "b")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).orderBy("k", "b").collect()
    )
    out: dict[Interval, list[tuple[float, float, int]]] = {}
    for r in rows:
        out.setdefault(intervals[r["k"]], []).append((r["low"], r["high"], r["n"]))
    return out
