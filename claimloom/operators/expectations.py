"""Warn-only data quality expectations: violations are counted, rows are never dropped."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_TRUTHY = "upper(trim(is_denied)) IN ('1', 'TRUE', 'YES', 'Y')"
_FALSY = "upper(trim(is_denied)) IN ('0', 'FALSE', 'NO', 'N')"


def _present(*columns: str) -> dict[str, str]:
    return {f"{c}_not_null": f"{c} IS NOT NULL" for c in columns}


def _positive_or_null(*columns: str) -> dict[str, str]:
    return {f"{c}_positive": f"{c} IS NULL OR try_cast({c} AS DOUBLE) > 0" for c in columns}


_PARSED = {"no_parse_errors": "_rescued_data IS NULL"}

# Expectation names and what each asserts.
EXPECTATIONS: dict[str, dict[str, str]] = {
    "claims": {
        **_present("claim_id", "patient_id", "provider_id"),
        **_positive_or_null("billed_amount"),
        **_PARSED,
        "claim_status_valid": "claim_status IS NULL OR upper(trim(claim_status)) IN ('APPROVED', 'DENIED')",
        "is_denied_matches_claim_status": (
            "claim_status IS NULL OR is_denied IS NULL"
            f" OR (upper(trim(claim_status)) = 'DENIED' AND {_TRUTHY})"
            f" OR (upper(trim(claim_status)) = 'APPROVED' AND {_FALSY})"
        ),
        "non_negative_payment_amounts": (
            "(allowed_amount IS NULL OR try_cast(allowed_amount AS DOUBLE) >= 0)"
            " AND (paid_amount IS NULL OR try_cast(paid_amount AS DOUBLE) >= 0)"
        ),
        "denial_reason_code_consistent": (
            "denial_reason_code IS NULL OR is_denied IS NULL"
            f" OR ({_FALSY} AND upper(trim(denial_reason_code)) = 'NONE')"
            f" OR ({_TRUTHY} AND upper(trim(denial_reason_code)) <> 'NONE')"
        ),
    },
    "providers": {
        **_present("provider_id", "doctor_name"),
        "location_present": "location IS NOT NULL",
        **_PARSED,
    },
    "diagnosis": {**_present("diagnosis_code", "category", "severity"), **_PARSED},
    "cost": {
        **_present("procedure_code"),
        **_positive_or_null("average_cost", "expected_cost"),
        **_present("region"),
        **_PARSED,
    },
    "policies": {
        "pdf_path_not_null": "path IS NOT NULL",
        "pdf_content_not_null": "content IS NOT NULL",
        "pdf_size_positive": "length > 0",
    },
}


def _counters(expectations: Mapping[str, str]) -> list[Column]:
    """One passed counter per expectation, then the total. A NULL verdict counts as failed."""
    passed = [F.count_if(F.expr(predicate)).alias(name) for name, predicate in expectations.items()]
    return [*passed, F.count(F.lit(1)).alias("_total")]


def evaluate(df: DataFrame, dataset: str, expectations: Mapping[str, str] | None = None) -> DataFrame:
    """Passed and failed record counts per expectation, from one pass over ``df``."""
    expectations = EXPECTATIONS[dataset] if expectations is None else expectations
    counts = df.agg(*_counters(expectations))
    long = counts.unpivot("_total", list(expectations), "expectation", "passed_records")
    return long.select(
        F.lit(dataset).alias("dataset"),
        "expectation",
        "passed_records",
        (F.col("_total") - F.col("passed_records")).alias("failed_records"),
    )


def observe(df: DataFrame, dataset: str, observation: Observation | str) -> DataFrame:
    """Attach the counters to ``df`` itself, batch or stream, without another pass."""
    return df.observe(observation, *_counters(EXPECTATIONS[dataset]))


def observed_rows(dataset: str, metrics: Mapping[str, int]) -> list[tuple[str, str, int, int]]:
    """Turn observed counters into ``(dataset, expectation, passed, failed)`` rows."""
    total = metrics["_total"]
    return [(dataset, name, metrics[name], total - metrics[name]) for name in EXPECTATIONS[dataset]]
