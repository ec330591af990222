"""Bronze to Silver: clean, validate, and divide every dataset into trusted and quarantined rows.

``validated_*`` returns every input row, cleaned, with ``_failure`` holding the first broken
rule or NULL. ``rules.trusted`` and ``rules.quarantined`` then divide it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import cleaning as C
from claimloom.functions import text as TX
from claimloom.functions.diagnostics import document_line
from claimloom.model import CLAIMS, COST, DIAGNOSIS, INGESTED_AT, MONEY, POLICIES, PROCESSED_AT
from claimloom.model import PROVIDERS, QUALITY_FLAGS, ROW_ID, RUN_ID, SOURCE_FILE, UNKNOWN_LOCATION
from claimloom.operators.lookups import lookup
from claimloom.operators.newest import PRIORITY, mark_newest, mark_newest_grouped
from claimloom.operators.rules import Rule, judge, quarantined, trusted

_CLAIM_MARKS = ("_provider_known", "_diagnosis_known")
HELPERS = (PRIORITY, ROW_ID, *_CLAIM_MARKS)

# Rule names, diagnostic numbers, order of precedence and reasons.
CLAIM_RULES = (
    Rule("missing_claim_id", 101, "claim_id is required for a trusted silver record", "claim_id IS NULL"),
    Rule("missing_patient_id", 102, "patient_id is required for a trusted silver record", "patient_id IS NULL"),
    Rule("missing_provider_id", 103, "provider_id is required for a trusted silver record", "provider_id IS NULL"),
    Rule("missing_diagnosis_code", 104, "diagnosis_code is required for a trusted silver record",
         "diagnosis_code IS NULL"),
    Rule("invalid_claim_date", 105, "claim date could not be parsed into yyyy-MM-dd", "date IS NULL"),
    Rule("unknown_provider_reference", 106, "provider_id does not match a known provider reference row",
         "_provider_known IS NULL"),
    Rule("unknown_diagnosis_reference", 107, "diagnosis_code does not match a known diagnosis reference row",
         "_diagnosis_known IS NULL"),
    Rule("inconsistent_denial_label", 108, "is_denied must agree with denial_reason_code != NONE",
         "is_denied IS NULL OR denial_reason_code IS NULL OR is_denied = (denial_reason_code = 'NONE')"),
    Rule("duplicate_claim_id", 109, "duplicate claim_id observed in the silver validation input",
         "_row_priority > 1"),
)
PROVIDER_RULES = (
    Rule("missing_provider_id", 201, "provider_id is required for a trusted provider record",
         "provider_id IS NULL"),
    Rule("missing_doctor_name", 202, "doctor_name is required for credential verification",
         "doctor_name IS NULL"),
    Rule("duplicate_provider_id", 203, "duplicate provider_id observed in the silver stream",
         "_row_priority > 1"),
)
DIAGNOSIS_RULES = (
    Rule("missing_diagnosis_code", 301, "diagnosis_code is required for lookup validation",
         "diagnosis_code IS NULL"),
    Rule("missing_category", 302, "category is required for specialty mismatch features", "category IS NULL"),
    Rule("missing_severity", 303, "severity is required for downstream risk features", "severity IS NULL"),
    Rule("invalid_severity", 304, "severity must normalize to High or Low", "severity NOT IN ('High', 'Low')"),
    Rule("duplicate_diagnosis_code", 305, "duplicate diagnosis_code observed in the silver stream",
         "_row_priority > 1"),
)
COST_RULES = (
    Rule("missing_procedure_code", 401, "procedure_code is required for benchmark joins",
         "procedure_code IS NULL"),
    Rule("missing_region", 404, "region is required for regional cost benchmarks", "region IS NULL"),
    Rule("invalid_average_cost", 402, "average_cost must parse to a positive decimal",
         "average_cost IS NULL OR average_cost <= 0"),
    Rule("invalid_expected_cost", 403, "expected_cost must parse to a positive decimal",
         "expected_cost IS NULL OR expected_cost <= 0"),
    Rule("duplicate_cost_key", 405, "duplicate procedure_code + region observed in the silver stream",
         "_row_priority > 1"),
)
DOCUMENT_RULES = (
    Rule("unreadable_pdf", 501, "policy text could not be extracted from the document",
         f"extraction_status = '{TX.UNREADABLE}'"),
    Rule("empty_pdf_text", 502, "policy document produced no extractable text",
         f"extraction_status = '{TX.EMPTY}'"),
    Rule("duplicate_policy_path", 503, "duplicate policy path observed in the silver stream",
         "_row_priority > 1"),
)
RULES = {
    "claims": CLAIM_RULES,
    "providers": PROVIDER_RULES,
    "diagnosis": DIAGNOSIS_RULES,
    "cost": COST_RULES,
    "policy_chunks": DOCUMENT_RULES,
}


def _stamp(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def known_keys(reference: DataFrame, key: str, mark: str) -> DataFrame:
    """Distinct normalised keys of a raw reference table, each marked as known."""
    keys = reference.select(C.code(key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return keys.withColumn(mark, F.lit(True))


def clean_claims(claims: DataFrame) -> DataFrame:
    text = {c: C.code(c) for c in ("claim_id", "patient_id", "provider_id", "diagnosis_code",
                                   "procedure_code", "claim_status", "denial_reason_code")}
    money = {c: C.decimal_or_null(c) for c in ("billed_amount", "allowed_amount", "paid_amount")}
    flags = {c: C.bool_or_null(c) for c in ("is_denied", "follow_up_required")}
    return claims.withColumns({**text, **money, **flags, "date": C.date_or_null("date")})


def mark_references(claims: DataFrame, providers: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Mark the claims whose provider and diagnosis exist in the raw reference tables."""
    marked = lookup(claims, known_keys(providers, "provider_id", "_provider_known"), on=["provider_id"])
    return lookup(marked, known_keys(diagnosis, "diagnosis_code", "_diagnosis_known"), on=["diagnosis_code"])


def validated_claims(
    claims: DataFrame,
    providers: DataFrame,
    diagnosis: DataFrame,
    as_of: Column | None = None,
) -> DataFrame:
    """Claims are wide and many, and many are sent again, so they meet by their key in one shuffle.

    ``claims`` is read twice: pass a stored table.
    """
    return judged_claims(mark_newest_grouped(clean_claims(claims), CLAIMS.keys), providers, diagnosis, as_of)


def judged_claims(ranked: DataFrame, providers: DataFrame, diagnosis: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Clean claims whose newest rows are marked. Columns that follow from others are added behind the joins."""
    marked = mark_references(ranked, providers, diagnosis).withColumns({
        PROCESSED_AT: _stamp(as_of),
        QUALITY_FLAGS: C.quality_flags({
            "missing_procedure_code": F.col("procedure_code").isNull(),
            "missing_billed_amount": F.col("billed_amount").isNull(),
        }),
    })
    ordered = [c for c in marked.columns if c not in (PRIORITY, *_CLAIM_MARKS)]
    return judge(marked.select(*ordered, PRIORITY, *_CLAIM_MARKS), CLAIM_RULES)


def validated_providers(providers: DataFrame, as_of: Column | None = None) -> DataFrame:
    """A missing location is flagged first and only then replaced by ``Unknown``."""
    cleaned = providers.withColumns({
        "provider_id": C.code("provider_id"),
        **{c: C.title(c) for c in ("doctor_name", "specialty", "location")},
    }).withColumns({
        PROCESSED_AT: _stamp(as_of),
        QUALITY_FLAGS: C.quality_flags({"provider_location_unknown": F.col("location").isNull()}),
    })
    filled = cleaned.withColumn("location", F.coalesce("location", F.lit(UNKNOWN_LOCATION)))
    return judge(mark_newest(filled, PROVIDERS.keys), PROVIDER_RULES)


def validated_diagnosis(diagnosis: DataFrame, as_of: Column | None = None) -> DataFrame:
    cleaned = diagnosis.withColumns({
        "diagnosis_code": C.code("diagnosis_code"),
        "category": C.title("category"),
        "severity": C.severity("severity"),
        PROCESSED_AT: _stamp(as_of),
        QUALITY_FLAGS: C.quality_flags({}),
    })
    return judge(mark_newest(cleaned, DIAGNOSIS.keys), DIAGNOSIS_RULES)


def validated_cost(cost: DataFrame, as_of: Column | None = None) -> DataFrame:
    cleaned = cost.withColumns({
        "procedure_code": C.code("procedure_code"),
        "average_cost": C.decimal_or_null("average_cost", MONEY.precision, MONEY.scale),
        "expected_cost": C.decimal_or_null("expected_cost", MONEY.precision, MONEY.scale),
        "region": C.title("region"),
        PROCESSED_AT: _stamp(as_of),
        QUALITY_FLAGS: C.quality_flags({}),
    })
    return judge(mark_newest(cleaned, COST.keys), COST_RULES)


def validated_documents(
    policies: DataFrame,
    as_of: Column | None = None,
    store_contest: bool = True,
    extract: Callable[[Column, Column], Column] = TX.extract_text,
) -> DataFrame:
    """Every landed document with its extracted text; only the newest version of a path is current.

    Text is extracted below the contest, so a filter on its outcome cannot repeat the work. With
    the contest stored, and few documents replaced, no document is ever shuffled.
    """
    newest = [F.coalesce(INGESTED_AT, "modificationTime"), F.col(RUN_ID), F.col(SOURCE_FILE)]
    is_markup = F.lower("path").rlike(r"\.html?$")
    read = policies.withColumn("_extracted", extract(F.col("content"), is_markup)).drop("content")
    extracted = mark_newest(read, POLICIES.keys, newest, store_contest=store_contest)
    columns = [c for c in extracted.columns if c != "_extracted"]
    documents = extracted.select(
        *columns,
        F.col("_extracted.policy_text").alias("policy_text"),
        F.col("_extracted.status").alias("extraction_status"),
        F.col("_extracted.error_message").alias("extraction_error_message"),
    ).withColumns({
        PROCESSED_AT: _stamp(as_of),
        QUALITY_FLAGS: C.quality_flags({
            "unreadable_pdf": F.col("extraction_status") == TX.UNREADABLE,
            "empty_pdf_text": F.col("extraction_status") == TX.EMPTY,
        }),
    })
    return judge(documents, DOCUMENT_RULES)


def policy_chunks(documents: DataFrame) -> DataFrame:
    """One row per token window of every trusted document. ``documents`` comes from validation."""
    exploded = trusted(documents).select(
        F.col("path").alias("document_path"), PROCESSED_AT, QUALITY_FLAGS, SOURCE_FILE, RUN_ID,
        F.inline(TX.chunks(F.col("policy_text"))),
    )
    return exploded.select(
        TX.chunk_id(F.col("document_path"), F.col("chunk_index")).alias("chunk_id"),
        "document_path", "chunk_index", "chunk_text", "token_count",
        F.lit(None).cast("array<double>").alias("embedding_vector"),
        F.lit("NOT_CONFIGURED").alias("embedding_status"),
        PROCESSED_AT, QUALITY_FLAGS, SOURCE_FILE, RUN_ID,
    )


def quarantined_documents(documents: DataFrame, as_of: Column | None = None) -> DataFrame:
    status = document_line(F.col("path"), 0, F.col("diagnostic_id"))
    return quarantined(documents, "policy_chunks", as_of, HELPERS, status)


def trusted_rows(validated: DataFrame) -> DataFrame:
    return trusted(validated, HELPERS)


def quarantined_rows(validated: DataFrame, dataset: str, as_of: Column | None = None) -> DataFrame:
    return quarantined(validated, dataset, as_of, HELPERS)
