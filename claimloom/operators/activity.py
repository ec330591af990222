"""Per-entity activity measures for each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_counts(daily: DataFrame, entity: str, day: str, count: str, days: int) -> Column:
    """Rows in the ``days`` days up to and including each day, from daily counts.

    ``daily`` has one row per entity and day, so an entity's window is bounded by the calendar
    however many rows it has.
    """
    window = Window.partitionBy(entity).orderBy(F.unix_date(day)).rangeBetween(-days, Window.currentRow)
    return F.when(F.col(day).isNotNull(), F.sum(count).over(window))


def provider_days(claims: DataFrame, days: int, approx: bool = False) -> DataFrame:
    """One row per provider and claim date with all provider-level features.

    Claims without a provider are left out. Everything is built from map-side combined counts.
    """
    known = claims.where(F.col("provider_id").isNotNull())
    daily = known.groupBy("provider_id", "date").agg(
        F.count(F.lit(1)).alias("_claims"), F.count_if(F.col("is_denied")).alias("_denied")
    )
    everything = Window.partitionBy("provider_id")
    daily = daily.select(
        "provider_id",
        "date",
        F.sum("_claims").over(everything).alias("provider_claim_count"),
        (F.sum("_denied").over(everything) / F.sum("_claims").over(everything)).alias("provider_risk_score"),
        trailing_counts(daily, "provider_id", "date", "_claims", days).alias("provider_claim_count_30d"),
    )
    distinct = F.approx_count_distinct if approx else F.count_distinct
    codes = known.groupBy(F.col("provider_id").alias("_provider")).agg(
        distinct("diagnosis_code").alias("diagnosis_count")
    )
    return daily.join(codes, F.col("provider_id") == F.col("_provider"), "left").drop("_provider")
