from functools import reduce
from operator import add

from pyspark.sql import functions as F

from claimloom import sinks


def test_place_on_the_curve_is_found_by_halving(spark):
    """Every edge was compared once for each bit; generated code of that size no longer compiled."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 17 != 0, F.concat(F.lit("C"), F.xxhash64("id").cast("string"))).alias("a"),
        F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(50)).cast("int")).alias("b"))
    edges = sinks._steps(rows, ["a", "b"])
    place = sinks.space_filling(rows, ["a", "b"])
    assert str(place).count(">=") <= 2 * sinks.STEPS
    number = {c: reduce(add, [F.coalesce((F.col(c) >= F.lit(e)).cast("int"), F.lit(0)) for e in edges[c]]) for c in edges}
    for r in rows.select(place.alias("place"), number["a"].alias("a"), number["b"].alias("b")).collect():
        assert r["place"] == sum((r[c] >> bit & 1) << (2 * bit + n) for n, c in enumerate("ab") for bit in range(6))
