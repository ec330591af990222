"""Rule flags per claim over the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.cleaning import quality_flags


def claim_flags(gold: DataFrame) -> DataFrame:
    """Every claim with the names of the checks it fails, in name order."""
    flags = quality_flags({
        "missing_procedure_code": F.col("is_procedure_missing"),
        "missing_billed_amount": F.col("is_amount_missing"),
        "over_benchmark": F.col("high_cost_flag"),
        "severity_procedure_mismatch": F.col("severity_procedure_mismatch"),
        "specialty_diagnosis_mismatch": F.col("specialty_diagnosis_mismatch"),
        "provider_location_missing": F.col("provider_location_missing"),
    })
    return gold.select("claim_id", flags.alias("rule_flags")).withColumn("flag_count", F.size("rule_flags"))
