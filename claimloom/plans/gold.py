"""Silver to Gold: one row of denial-risk features per trusted claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.cleaning import ratio
from claimloom.model import GOLD_COLUMNS, GOLD_PROCESSED_AT, HIGH_COST_RATIO, LOW_EXPECTED_COST, TRAILING_DAYS, UNKNOWN_LOCATION
from claimloom.operators.activity import provider_days
from claimloom.operators.lookups import lookup

# Known only after adjudication: a model that saw these would be reading the answer.
OUTCOME_COLUMNS = ("claim_status", "denial_reason_code", "allowed_amount", "paid_amount", "follow_up_required")
# What the features of a claim are made from.
CLAIM_INPUTS = ("claim_id", "provider_id", "diagnosis_code", "procedure_code", "date", "billed_amount", "is_denied")


# Claims meet the activity of their provider by these.
ACTIVITY_KEYS = ("provider_id", "date")


def _or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _with_benchmarks(rows: DataFrame, diagnosis: DataFrame, cost: DataFrame) -> DataFrame:
    rows = lookup(rows, diagnosis.select("diagnosis_code", "category", "severity"), on=["diagnosis_code"])
    benchmarks = cost.select("procedure_code", "region", "average_cost", "expected_cost")
    return lookup(rows, benchmarks, on={"procedure_code": "procedure_code", "location": "region"})


def benchmark_join(claims: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame) -> DataFrame:
    """Claims with provider, diagnosis and the cost benchmark of the provider's region."""
    rows = lookup(claims, providers.select("provider_id", "specialty", "location"), on=["provider_id"])
    return _with_benchmarks(rows, diagnosis, cost)


def claim_features(joined: DataFrame, imputed_is_missing: bool = False) -> DataFrame:
    """Features that need nothing but the claim and its joined references.

    With ``imputed_is_missing`` a location that cleaning had to fill counts as missing too.
    """
    no_location = F.col("location").isNull()
    if imputed_is_missing:
        no_location = no_location | (F.col("location") == UNKNOWN_LOCATION)
    specialty, category = F.lower("specialty"), F.lower("category")
    return joined.withColumns({
        "is_procedure_missing": F.col("procedure_code").isNull(),
        "is_amount_missing": F.col("billed_amount").isNull(),
        "amount_to_benchmark_ratio": ratio("billed_amount", "expected_cost"),
        "billed_vs_avg_cost": ratio("billed_amount", "average_cost"),
        "severity_procedure_mismatch": _or_false(
            (F.col("severity") == "High") & (F.col("expected_cost") < LOW_EXPECTED_COST)
        ),
        "specialty_diagnosis_mismatch": specialty != category,
        "provider_location_missing": no_location,
        "diagnosis_severity_encoded": F.when(F.col("severity") == "High", 1).when(F.col("severity") == "Low", 0),
        "denial_label": _or_false(F.col("is_denied")).cast("int"),
    }).withColumn("high_cost_flag", _or_false(F.col("amount_to_benchmark_ratio") >= HIGH_COST_RATIO))


def gold_features(
    claims: DataFrame,
    providers: DataFrame,
    diagnosis: DataFrame,
    cost: DataFrame,
    as_of: Column | None = None,
    approx_diagnosis_count: bool = False,
    columns: Sequence[str] = GOLD_COLUMNS,
) -> DataFrame:
    """The 34-column feature table, or some ``columns`` of it.

    ``claims`` is read for the features and again for the provider activity, so pass a stored
    table. Everything about providers, their attributes too, rides on one frame with a row per
    provider and day, so the claims meet providers once, then diagnosis, then cost. Claims stored in
    buckets by ``ACTIVITY_KEYS`` meet it where they lie.
    """
    activity = provider_days(claims, TRAILING_DAYS, approx_diagnosis_count)
    people = lookup(activity, providers.select("provider_id", "specialty", "location"), on=["provider_id"])
    # A null-safe comparison is no plain key, so it would have the wide rows shuffled; few tables need one.
    undated = [] if claims.where(F.col("date").isNull()).isEmpty() else ["date"]
    rows = lookup(claims.drop(*OUTCOME_COLUMNS), people, on=ACTIVITY_KEYS, null_safe=undated)
    stamped = claim_features(_with_benchmarks(rows, diagnosis, cost)).withColumn(GOLD_PROCESSED_AT, F.current_timestamp() if as_of is None else as_of)
    return stamped.select(*columns)
