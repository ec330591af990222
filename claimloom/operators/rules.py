"""Row rules: the first one a row breaks decides where it goes and why."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.diagnostics import PREFIX, UNKNOWN_RULE, diagnostic_id, quarantine_line
from claimloom.model import QUARANTINED_AT

FAILURE = "_failure"
FAILURE_FIELDS = ("diagnostic_id", "rule_name", "quarantine_reason")


@dataclass(frozen=True)
class Rule:
    """``broken`` holds for the rows that violate the rule; NULL counts as not violated."""

    name: str
    number: int
    reason: str
    broken: str


def rule_diagnostic(rules: Sequence[Rule], name: str, prefix: str = PREFIX) -> str:
    number = next((r.number for r in rules if r.name == name), UNKNOWN_RULE)
    return diagnostic_id("SLV", number, prefix)


def first_failure(rules: Sequence[Rule], prefix: str = PREFIX) -> Column:
    """``struct(diagnostic_id, rule_name, quarantine_reason)`` of the first broken rule, else NULL."""
    chain = F
    for rule in rules:
        values = (diagnostic_id("SLV", rule.number, prefix), rule.name, rule.reason)
        verdict = F.struct(*(F.lit(v).alias(f) for f, v in zip(FAILURE_FIELDS, values)))
        chain = chain.when(F.expr(rule.broken), verdict)
    return chain


def judge(df: DataFrame, rules: Sequence[Rule], prefix: str = PREFIX) -> DataFrame:
    return df.withColumn(FAILURE, first_failure(rules, prefix))


def trusted(judged: DataFrame, helpers: Sequence[str] = ()) -> DataFrame:
    """Rows that broke no rule."""
    return judged.where(F.col(FAILURE).isNull()).drop(FAILURE, *helpers)


def quarantined(
    judged: DataFrame,
    dataset: str,
    as_of: Column | None = None,
    helpers: Sequence[str] = (),
    status: Column | None = None,
) -> DataFrame:
    """Rows that broke a rule, with the rule, its reason and a status line without row values."""
    failed = judged.where(F.col(FAILURE).isNotNull())
    failed = failed.select(*[c for c in failed.columns if c not in (FAILURE, *helpers)], f"{FAILURE}.*")
    line = status if status is not None else quarantine_line(
        F.lit(dataset), F.col("rule_name"), F.col("diagnostic_id"), F.lit(1)
    )
    return failed.withColumns(
        {"status_message": line, QUARANTINED_AT: F.current_timestamp() if as_of is None else as_of}
    )


def reconcile(judged: DataFrame, dataset: str) -> DataFrame:
    """One row: how the input divides into trusted and quarantined, in a single pass."""
    return judged.agg(
        F.lit(dataset).alias("dataset"),
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(F.col(FAILURE).isNull()).alias("trusted_rows"),
        F.count_if(F.col(FAILURE).isNotNull()).alias("quarantined_rows"),
    ).withColumn(
        "unaccounted_rows", F.col("input_rows") - F.col("trusted_rows") - F.col("quarantined_rows")
    )
