"""Stable diagnostic identifiers and status lines that carry no row values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "CLM"

# The identifier domains and the failure number of each dataset.
DOMAINS = ("BRZ", "ANL", "HIPAA", "OBS", "SLV", "QRT")
FAILURE_NUMBERS = {"claims": 401, "providers": 402, "diagnosis": 403, "cost": 404, "policies": 405}
UNKNOWN_FAILURE = 499
UNKNOWN_RULE = 999

CATEGORIES = (
    "pipeline_ops", "data_quality", "governance_audit", "analytics_build",
    "silver_pipeline", "quarantine_audit", "policy_chunking", "gold_pipeline",
)


def diagnostic_id(domain: str, number: int, prefix: str = PREFIX) -> str:
    """The identifier of a rule or failure by its domain and its number there, such as CLM-SLV-201."""
    return "-".join((prefix, domain.upper(), str(number).zfill(3)))


def failure_id(dataset: str | None) -> str:
    return diagnostic_id("OBS", FAILURE_NUMBERS.get(dataset, UNKNOWN_FAILURE))


def failure_id_of(dataset: Column) -> Column:
    """Diagnostic of a failed dataset, by map lookup; unknown or NULL names get the fallback."""
    pairs = [F.lit(x) for name in FAILURE_NUMBERS for x in (name, failure_id(name))]
    return F.coalesce(F.create_map(*pairs)[dataset], F.lit(failure_id(None)))


# The texts of the status lines.


def table_ready(layer: str, table: str, category: str, sensitivity: str) -> str:
    return f"{layer} dataset ready: table={table} category={category} sensitivity={sensitivity}"


def quarantine_line(dataset: Column, rule: Column, diagnostic: Column, records: Column) -> Column:
    return F.concat(
        F.lit("Quarantine summary recorded: dataset="), dataset,
        F.lit(" rule_name="), rule,
        F.lit(" diagnostic_id="), diagnostic,
        F.lit(" quarantined_records="), records.cast("string"),
    )


def document_line(path: Column, chunk_count: int, diagnostic: Column) -> Column:
    return F.concat(
        F.lit("Policy chunk extraction recorded: document_path="), path,
        F.lit(f" chunk_count={chunk_count} diagnostic_id="), diagnostic,
    )


def expectation_line(name: Column, dataset: Column, passed: Column, failed: Column) -> Column:
    return F.concat(
        F.lit("Expectation metric recorded: expectation="), name,
        F.lit(" dataset="), dataset,
        F.lit(" passed_records="), passed.cast("string"),
        F.lit(" failed_records="), failed.cast("string"),
    )
