"""Distribution drift between a baseline and a current sample of one score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.quantiles import exact_quantiles

BUCKETS = 10
ALERT_PSI = 0.2
FLOOR = 0.0001


def drift_buckets(baseline: DataFrame, current: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of each side per baseline quantile bucket. Buckets without any row are left out.

    The edges are exact quantiles; every row is placed by counting the edges below it.
    """
    shares = [i / buckets for i in range(1, buckets)]
    edges = F.array(*(F.lit(e).cast("double") for e in exact_quantiles(baseline, column, shares)))
    sides = baseline.select(F.col(column).alias("_v"), F.lit(True).alias("_base")).unionByName(
        current.select(F.col(column).alias("_v"), F.lit(False).alias("_base"))
    )
    placed = sides.where(F.col("_v").isNotNull()).withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("_v"))))
    return placed.groupBy("bucket").agg(
        F.count_if(F.col("_base")).alias("baseline_rows"), F.count_if(~F.col("_base")).alias("current_rows")
    )


def stability_index(counts: DataFrame) -> DataFrame:
    """Population stability index over the buckets, with an alert above the limit."""
    total = counts.agg(
        F.sum("baseline_rows").alias("_b"), F.sum("current_rows").alias("_c"), F.lit(1).alias("_one")
    )
    rows = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    expected = F.greatest(F.col("baseline_rows") / F.col("_b"), F.lit(FLOOR))
    actual = F.greatest(F.col("current_rows") / F.col("_c"), F.lit(FLOOR))
    index = F.round(F.sum((actual - expected) * F.ln(actual / expected)), 6).alias("psi")
    return rows.agg(index).withColumn("alert", F.coalesce(F.col("psi") > ALERT_PSI, F.lit(False)))
