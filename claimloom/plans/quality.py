"""Status and quarantine summaries over the validated datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.cleaning import percent
from claimloom.functions.diagnostics import quarantine_line, table_ready
from claimloom.operators.rules import FAILURE

ALERT_QUARANTINE_PCT = 5.0


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_status(
    trusted: dict[str, DataFrame], quarantine: dict[str, DataFrame], namespace: "Namespace"  # noqa: F821
) -> DataFrame:
    """One row per dataset with the sizes of its trusted and its quarantine table.

    Every table is counted once and the two counts meet in a tiny grouped sum; nothing is
    counted on the driver.
    """
    counts = _stacked([
        df.agg(
            F.lit(name).alias("dataset"),
            (F.count(F.lit(1)) if is_trusted else F.lit(0).cast("long")).alias("silver_row_count"),
            (F.lit(0).cast("long") if is_trusted else F.count(F.lit(1))).alias("quarantine_row_count"),
        )
        for side, is_trusted in ((trusted, True), (quarantine, False))
        for name, df in side.items()
    ])
    totals = counts.groupBy("dataset").agg(
        F.sum("silver_row_count").alias("silver_row_count"),
        F.sum("quarantine_row_count").alias("quarantine_row_count"),
    )
    return _with_tables(totals, list(trusted), namespace)


def table_status_of(validated: dict[str, DataFrame], namespace: "Namespace", silver_rows: dict[str, str] | None = None) -> DataFrame:  # noqa: F821
    """The same from validated rows, before they are divided: one pass per dataset.

    ``silver_rows`` may name a column holding how many trusted rows an input row becomes.
    """
    silver_rows = silver_rows or {}
    totals = _stacked([
        df.agg(
            F.lit(name).alias("dataset"),
            (
                F.coalesce(F.sum(silver_rows[name]), F.lit(0))
                if name in silver_rows
                else F.count_if(F.col(FAILURE).isNull())
            ).alias("silver_row_count"),
            F.count_if(F.col(FAILURE).isNotNull()).alias("quarantine_row_count"),
        )
        for name, df in validated.items()
    ])
    return _with_tables(totals, list(validated), namespace)


def _with_tables(totals: DataFrame, datasets: list[str], namespace) -> DataFrame:
    def by_dataset(value) -> F.Column:
        return F.create_map(*[F.lit(x) for d in datasets for x in (d, value(d))])[F.col("dataset")]

    def ready(dataset: str) -> str:
        sensitivity = "PHI" if dataset == "claims" else "NON-PHI"
        return table_ready("Silver", namespace.silver(dataset), "silver_pipeline", sensitivity)

    return totals.select(
        "dataset",
        by_dataset(namespace.silver).alias("silver_table"),
        "silver_row_count",
        by_dataset(namespace.quarantine).alias("quarantine_table"),
        "quarantine_row_count",
        by_dataset(ready).alias("status_message"),
    )


def quarantine_summary(quarantine: dict[str, DataFrame]) -> DataFrame:
    """Quarantined rows per dataset, rule and diagnostic."""
    counts = _stacked([
        df.groupBy(F.lit(name).alias("dataset"), "rule_name", "diagnostic_id")
        .agg(F.count(F.lit(1)).alias("quarantined_records"))
        for name, df in quarantine.items()
    ])
    line = quarantine_line(
        F.col("dataset"), F.col("rule_name"), F.col("diagnostic_id"), F.col("quarantined_records")
    )
    return counts.withColumns({"status_message": line, "category": F.lit("quarantine_audit")})


def quarantine_alerts(status: DataFrame, limit_pct: float = ALERT_QUARANTINE_PCT) -> DataFrame:
    """Share of quarantined rows per dataset, and whether it exceeds the limit."""
    rows = F.col("silver_row_count") + F.col("quarantine_row_count")
    rate = percent(F.col("quarantine_row_count"), rows)
    return status.select("dataset", rate.alias("quarantine_pct")).withColumn(
        "alert", F.coalesce(F.col("quarantine_pct") > limit_pct, F.lit(False))
    )
