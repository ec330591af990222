import datetime
import re

import pytest
from pyspark.sql import functions as F

from claimloom.functions.diagnostics import diagnostic_id, failure_id
from claimloom.operators.rules import FAILURE, first_failure, reconcile, rule_diagnostic
from claimloom.plans import silver

AUDIT = "_ingested_at timestamp, _source_file string, _pipeline_run_id string, _rescued_data string"
T1, T2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)


def frame(spark, columns, rows):
    schema = ", ".join(f"{c} string" for c in columns) + ", " + AUDIT
    return spark.createDataFrame([(*r[:-1], r[-1], "f", "r", None) for r in rows], schema)


CLAIM_COLUMNS = ("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "date", "claim_status",
                 "denial_reason_code", "allowed_amount", "paid_amount", "is_denied", "follow_up_required")


def claim(claim_id, at=T1, **changes):
    values = dict(zip(CLAIM_COLUMNS, (claim_id, "p1", "pr1", "d10", "proc1", "100.0", "2024-02-22", "approved", "none", "85", "85", "0", "0")))
    values.update(changes)
    return (*values.values(), at)


@pytest.fixture()
def references(spark):
    providers = frame(spark, ("provider_id", "doctor_name", "specialty", "location"), [("PR1 ", "dr a md", "heart", None, T1), ("pr2", None, "bone", "delhi", T1)])
    diagnosis = frame(spark, ("diagnosis_code", "category", "severity"), [("D10", "heart", "high", T1), ("D20", "bone", "medium", T1), ("D30", "skin", None, T1)])
    return providers, diagnosis


def test_first_broken_rule_wins(spark, references):
    rows = [
        claim("c1"), claim(" ", patient_id=""), claim(None), claim("c3", patient_id=None, provider_id=None), claim("c4", provider_id=" "),
        claim("c5", diagnosis_code=None, date="2024/02/22"), claim("c6", date="2024/02/22", provider_id="zz"), claim("c7", provider_id="zz"),
        claim("c8", diagnosis_code="d99"), claim("c9", is_denied=None), claim("c10", denial_reason_code=" "), claim("c11", is_denied="1"),
        claim("c12", denial_reason_code="MEDICAL_REVIEW"), claim("c13", is_denied="yes", denial_reason_code="OVER_BENCHMARK"),
        claim("c14"), claim("C14 ", at=T2, is_denied=None), claim("c15", provider_id="pr2"),
    ]
    checked = silver.validated_claims(frame(spark, CLAIM_COLUMNS, rows), *references)
    got = sorted((r["claim_id"] or "", r["rule"] or "") for r in checked.select("claim_id", F.col(f"{FAILURE}.rule_name").alias("rule")).collect())
    assert got == sorted([
        ("C1", ""), ("", "missing_claim_id"), ("", "missing_claim_id"), ("C3", "missing_patient_id"), ("C4", "missing_provider_id"),
        ("C5", "missing_diagnosis_code"), ("C6", "invalid_claim_date"), ("C7", "unknown_provider_reference"),
        ("C8", "unknown_diagnosis_reference"), ("C9", "inconsistent_denial_label"), ("C10", "inconsistent_denial_label"),
        ("C11", "inconsistent_denial_label"), ("C12", "inconsistent_denial_label"), ("C13", ""),
        ("C14", "duplicate_claim_id"), ("C14", "inconsistent_denial_label"), ("C15", ""),
    ])
    total = reconcile(checked, "claims").first()
    assert (total["input_rows"], total["trusted_rows"], total["quarantined_rows"], total["unaccounted_rows"]) == (17, 3, 14, 0)
    held = silver.quarantined_rows(checked, "claims").where("claim_id = 'C9'").first()
    assert held["diagnostic_id"] == "CLM-SLV-108"
    assert held["status_message"] == (
        "Quarantine summary recorded: dataset=claims rule_name=inconsistent_denial_label diagnostic_id=CLM-SLV-108 quarantined_records=1")
    assert not set(silver.HELPERS) & set(silver.trusted_rows(checked).columns)


def test_provider_location_flag_precedes_imputation(spark, references):
    rows = {r["provider_id"]: r for r in silver.validated_providers(references[0]).collect()}
    assert rows["PR1"]["location"] == "Unknown" and rows["PR1"]["_data_quality_flags"] == ["provider_location_unknown"]
    assert rows["PR1"]["doctor_name"] == "Dr A MD" and rows["PR1"][FAILURE] is None
    assert rows["PR2"][FAILURE]["rule_name"] == "missing_doctor_name"


def test_diagnosis_severity(spark, references):
    rows = {r["diagnosis_code"]: r[FAILURE] for r in silver.validated_diagnosis(references[1]).collect()}
    assert rows["D10"] is None and rows["D20"]["rule_name"] == "invalid_severity" and rows["D30"]["rule_name"] == "missing_severity"


def test_cost_rule_order(spark):
    rows = [("p1", "10", "20", "delhi", T1), ("p1", "10", "20", " Delhi", T2), (None, "0", "0", None, T1), ("p2", "0", "x", None, T1),
            ("p3", "-1", "x", "goa", T1), ("p4", "1", "x", "goa", T1), ("p5", "1", "0", "goa", T1)]
    df = silver.validated_cost(frame(spark, ("procedure_code", "average_cost", "expected_cost", "region"), rows))
    got = sorted((r["procedure_code"] or "", (r[FAILURE] or {"rule_name": ""})["rule_name"]) for r in df.collect())
    assert got == sorted([("P1", "duplicate_cost_key"), ("P1", ""), ("", "missing_procedure_code"), ("P2", "missing_region"),
                          ("P3", "invalid_average_cost"), ("P4", "invalid_expected_cost"), ("P5", "invalid_expected_cost")])


def test_empty_input(spark, references):
    empty = frame(spark, CLAIM_COLUMNS, [claim("x")]).limit(0)
    checked = silver.validated_claims(empty, *references)
    assert checked.count() == 0 and reconcile(checked, "claims").first()["input_rows"] == 0


def test_diagnostic_identifiers():
    assert rule_diagnostic(silver.CLAIM_RULES, "missing_diagnosis_code") == "CLM-SLV-104"
    assert rule_diagnostic(silver.CLAIM_RULES, "no such rule") == "CLM-SLV-999"
    assert failure_id("claims") == "CLM-OBS-401" and failure_id("other") == "CLM-OBS-499"
    assert diagnostic_id("obs", 7, "ABC") == "ABC-OBS-007"
    numbers = [r.number for found in silver.RULES.values() for r in found]
    assert all(re.fullmatch(r"CLM-SLV-\d{3}", diagnostic_id("SLV", n)) for n in numbers) and len(set(numbers)) == len(numbers)


def test_no_rules_broken_is_null(spark):
    row = spark.createDataFrame([("a",)], "claim_id string").select(first_failure(silver.CLAIM_RULES[:1]).alias("f")).first()
    assert row["f"] is None
