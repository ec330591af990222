"""Rule-based adjudication labels for claims that have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.cleaning import decimal_or_null, trim_to_null
from claimloom.model import MONEY
from claimloom.operators.lookups import lookup
from claimloom.sinks import stage

# The rule thresholds and the columns the rules write.
OVER_BENCHMARK_RATIO = "2.5"
REVIEW_SHARE = "0.60"
BENCHMARK_SHARE = "1.05"
DEFAULT_SHARE = "0.85"
LABELS = (
    "claim_status", "denial_reason_code", "allowed_amount", "paid_amount", "is_denied", "follow_up_required",
)


def _money(value: Column) -> Column:
    return F.round(value, 2).cast(MONEY)


def _share(value: Column, share: str) -> Column:
    return _money(value * F.lit(share).cast("decimal(4,2)"))


def expected_costs(claims: DataFrame, providers: DataFrame, cost: DataFrame) -> DataFrame:
    """Claims with ``expected_cost`` of (procedure, provider's location); not above zero counts as none."""
    people = providers.select("provider_id", F.col("location").alias("_location"))
    benchmarks = cost.select("procedure_code", "region", decimal_or_null("expected_cost").alias("expected_cost"))
    rows = lookup(claims, people, on=["provider_id"])
    rows = lookup(rows, benchmarks, on={"procedure_code": "procedure_code", "_location": "region"})
    usable = F.when(F.col("expected_cost") > 0, F.col("expected_cost"))
    return rows.withColumn("expected_cost", usable).drop("_location")


def classified(claims: DataFrame) -> DataFrame:
    """Add ``denial_reason_code`` and ``allowed_amount`` from the first matching rule.

    Expects ``expected_cost`` and a boolean ``in_review``; a cost not above zero counts as none, and an
    allowed amount of NULL means zero.
    """
    billed, expected = decimal_or_null("billed_amount"), F.when(F.col("expected_cost") > 0, F.col("expected_cost"))
    over = F.coalesce(billed > expected * F.lit(OVER_BENCHMARK_RATIO).cast("decimal(4,2)"), F.lit(False))
    cases = (
        (trim_to_null("procedure_code").isNull(), "MISSING_PROCEDURE", F.lit(None)),
        (billed.isNull(), "MISSING_BILLED_AMOUNT", F.lit(None)),
        (over, "OVER_BENCHMARK", _money(expected)),
        (F.col("in_review"), "MEDICAL_REVIEW", _share(billed, REVIEW_SHARE)),
        (expected.isNotNull(), "NONE", F.least(billed.cast(MONEY), _share(expected, BENCHMARK_SHARE))),
        (F.lit(True), "NONE", _share(billed, DEFAULT_SHARE)),
    )
    verdict = F
    for condition, reason, allowed in cases:
        verdict = verdict.when(
            condition, F.struct(F.lit(reason).alias("reason"), allowed.cast(MONEY).alias("allowed"))
        )
    return claims.withColumn("_verdict", verdict).withColumns({
        "denial_reason_code": F.col("_verdict.reason"),
        "allowed_amount": F.coalesce("_verdict.allowed", F.lit(0).cast(MONEY)),
    }).drop("_verdict")


def in_review(claims: DataFrame, review_ids: DataFrame) -> DataFrame:
    """Mark the claims whose id is in the review table. The ids are stored first, so their size is known."""
    ids = stage(review_ids.select("claim_id").distinct(), "review_ids").withColumn("_review", F.lit(True))
    marked = lookup(claims, ids, on=["claim_id"])
    return marked.withColumn("in_review", F.col("_review").isNotNull()).drop("_review")


def relabelled(claims: DataFrame, providers: DataFrame, cost: DataFrame, review_ids: DataFrame) -> DataFrame:
    """Claims with all six label columns recomputed, as text like the landed files hold them."""
    bare = claims.drop(*LABELS)
    judged = classified(in_review(expected_costs(bare, providers, cost), review_ids))
    denied = F.col("denial_reason_code") != "NONE"
    flag = F.when(denied, "1").otherwise("0")
    return judged.drop("expected_cost", "in_review").withColumns({
        "claim_status": F.when(denied, "DENIED").otherwise("APPROVED"),
        "paid_amount": F.when(denied, F.lit("0.00")).otherwise(F.col("allowed_amount").cast("string")),
        "allowed_amount": F.col("allowed_amount").cast("string"),
        "is_denied": flag,
        "follow_up_required": flag,
    })


def label_drift(claims: DataFrame, recomputed: DataFrame, keys: tuple[str, ...] = ("claim_id",)) -> DataFrame:
    """Claims whose stored labels differ from the recomputed ones, NULLs compared as values.

    Both sides are as large as the claims; the adaptive plan splits a skewed key.
    """
    fresh = recomputed.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in LABELS))
    both = lookup(claims.select(*keys, *LABELS), fresh, on=list(keys))
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"_new_{c}")), F.lit(c)) for c in LABELS]
    return (
        both.select(*keys, F.array_compact(F.array(*changed)).alias("changed_columns"))
        .where(F.size("changed_columns") > 0)
    )
