"""The datasets, their columns and the names every layer shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INGESTED_AT = "_ingested_at"
SOURCE_FILE = "_source_file"
RUN_ID = "_pipeline_run_id"
RESCUED = "_rescued_data"
UNKNOWN_LOCATION = "Unknown"
ROW_ID = "_row_id"
BATCH = "_batch"
PROCESSED_AT = "_silver_processed_at"
QUALITY_FLAGS = "_data_quality_flags"
QUARANTINED_AT = "_quarantined_at"
GOLD_PROCESSED_AT = "_gold_processed_at"

AUDIT = (INGESTED_AT, SOURCE_FILE, RUN_ID)
NEWEST_FIRST = (INGESTED_AT, RUN_ID, SOURCE_FILE)

MONEY = T.DecimalType(18, 2)
RUN_ID_CONF = "claimloom.pipeline_run_id"

HIGH_COST_RATIO = 1.5
LOW_EXPECTED_COST = 5000
TRAILING_DAYS = 30


@dataclass(frozen=True)
class Dataset:
    """One landed dataset: what its files hold and how its tables are laid out."""

    name: str
    columns: tuple[str, ...]
    keys: tuple[str, ...]
    cluster: tuple[str, ...]
    phi: frozenset[str] = frozenset()
    linkable: frozenset[str] = frozenset()
    expected_rows: int | None = None

    @property
    def sensitivity(self) -> str:
        return "PHI" if self.phi else "NON-PHI"

    def raw_schema(self) -> T.StructType:
        """All landed CSV columns are text; nothing is inferred."""
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns])


# Column names, keys, expected row counts and privacy sets of the landed files.
CLAIMS = Dataset(
    name="claims",
    columns=(
        "claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code",
        "billed_amount", "date", "claim_status", "denial_reason_code", "allowed_amount",
        "paid_amount", "is_denied", "follow_up_required",
    ),
    keys=("claim_id",),
    cluster=("claim_id", "date"),
    phi=frozenset({
        "patient_id", "diagnosis_code", "billed_amount", "date", "claim_status",
        "denial_reason_code", "allowed_amount", "paid_amount", "is_denied", "follow_up_required",
    }),
    linkable=frozenset({"claim_id", "provider_id", "procedure_code"}),
    expected_rows=1000,
)
PROVIDERS = Dataset(
    name="providers",
    columns=("provider_id", "doctor_name", "specialty", "location"),
    keys=("provider_id",),
    cluster=("provider_id", "specialty"),
    expected_rows=21,
)
DIAGNOSIS = Dataset(
    name="diagnosis",
    columns=("diagnosis_code", "category", "severity"),
    keys=("diagnosis_code",),
    cluster=("diagnosis_code", "severity"),
    expected_rows=6,
)
COST = Dataset(
    name="cost",
    columns=("procedure_code", "average_cost", "expected_cost", "region"),
    keys=("procedure_code", "region"),
    cluster=("procedure_code", "region"),
    expected_rows=6,
)
POLICIES = Dataset(
    name="policies",
    columns=("path", "modificationTime", "length", "content"),
    keys=("path",),
    cluster=("document_path", "chunk_id"),
)

CSV_DATASETS = {d.name: d for d in (CLAIMS, PROVIDERS, DIAGNOSIS, COST)}
ALL_DATASETS = {**CSV_DATASETS, POLICIES.name: POLICIES}

GOLD_PHI = frozenset({"billed_amount", "date", "diagnosis_code", "is_denied", "patient_id"})

GOLD_COLUMNS = (
    "claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code",
    "billed_amount", "date", "specialty", "location", "category", "severity",
    "average_cost", "expected_cost", "is_denied", "is_procedure_missing",
    "is_amount_missing", "amount_to_benchmark_ratio", "billed_vs_avg_cost",
    "high_cost_flag", "severity_procedure_mismatch", "specialty_diagnosis_mismatch",
    "provider_location_missing", "diagnosis_severity_encoded", "diagnosis_count",
    "provider_claim_count", "provider_claim_count_30d", "provider_risk_score",
    "denial_label", GOLD_PROCESSED_AT, INGESTED_AT, SOURCE_FILE, RUN_ID,
    PROCESSED_AT, QUALITY_FLAGS,
)

# The model's inputs, what a missing input counts as, and the target.
FEATURE_FILL = {
    "is_procedure_missing": 0,
    "is_amount_missing": 0,
    "amount_to_benchmark_ratio": 0.0,
    "billed_vs_avg_cost": 0.0,
    "high_cost_flag": 0,
    "severity_procedure_mismatch": 0,
    "specialty_diagnosis_mismatch": 0,
    "provider_location_missing": 0,
    "diagnosis_severity_encoded": 0,
    "diagnosis_count": 1,
    "provider_claim_count": 0,
    "provider_claim_count_30d": 0,
    "provider_risk_score": 0.0,
}
FEATURES = tuple(FEATURE_FILL)
TARGET = "denial_label"
