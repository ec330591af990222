import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom import model as M
from claimloom.functions import privacy
from claimloom.namespace import Namespace
from claimloom.operators import drift, expectations, profiling
from claimloom.operators.flags import claim_flags
from claimloom.plans import analytics, labels, quality

CLAIMS = "claim_id string, provider_id string, procedure_code string, billed_amount string"


def labelled(spark, *rows):
    df = spark.createDataFrame(rows, "claim_id string, procedure_code string, billed_amount string, expected_cost decimal(18,2), in_review boolean")
    return {r["claim_id"]: (r["denial_reason_code"], str(r["allowed_amount"])) for r in labels.classified(df).collect()}


def test_label_rules(spark):
    d = Decimal
    got = labelled(
        spark, ("a", None, "5", d(1), False), ("b", "x", "", d(1), False), ("c", "x", "250.01", d(100), True), ("d", "x", "250", d(100), True),
        ("e", "x", "90.55", d(100), False), ("f", "x", "200", d(100), False), ("g", "x", "100", None, False), ("h", "x", "0.03", None, True))
    assert got == {
        "a": ("MISSING_PROCEDURE", "0.00"), "b": ("MISSING_BILLED_AMOUNT", "0.00"), "c": ("OVER_BENCHMARK", "100.00"),
        "d": ("MEDICAL_REVIEW", "150.00"), "e": ("NONE", "90.55"), "f": ("NONE", "105.00"), "g": ("NONE", "85.00"), "h": ("MEDICAL_REVIEW", "0.02")}


def test_relabelling_and_drift(spark):
    claims = spark.createDataFrame([("a", "p", "x", "100"), ("b", "p", "x", "900"), ("c", "q", "x", "100"), ("d", "p", None, "1")], CLAIMS)
    providers = spark.createDataFrame([("p", "delhi"), ("q", "goa")], "provider_id string, location string")
    cost = spark.createDataFrame([("x", "delhi", "300"), ("x", "goa", "0")], "procedure_code string, region string, expected_cost string")
    review = spark.createDataFrame([("c",), ("c",)], "claim_id string")
    out = labels.relabelled(claims, providers, cost, review)
    got = {r["claim_id"]: tuple(r[c] for c in labels.LABELS) for r in out.collect()}
    assert got == {
        "a": ("APPROVED", "NONE", "100.00", "100.00", "0", "0"), "b": ("DENIED", "OVER_BENCHMARK", "300.00", "0.00", "1", "1"),
        "c": ("DENIED", "MEDICAL_REVIEW", "60.00", "0.00", "1", "1"), "d": ("DENIED", "MISSING_PROCEDURE", "0.00", "0.00", "1", "1")}
    assert labels.label_drift(out, out).count() == 0
    stale = out.withColumn("paid_amount", F.when(F.col("claim_id") == "a", None).otherwise(F.col("paid_amount")))
    assert [(r["claim_id"], r["changed_columns"]) for r in labels.label_drift(stale, out).collect()] == [("a", ["paid_amount"])]


def adjudicated(spark, rows):
    schema = ("claim_id string, date date, denial_reason_code string, is_denied boolean, follow_up_required boolean, "
              "billed_amount decimal(18,2), allowed_amount decimal(18,2), paid_amount decimal(18,2)")
    return spark.createDataFrame(rows, schema)


def test_adjudication_truth_table(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("1", day, "NONE", False, False, Decimal(100), Decimal(80), Decimal(80)), ("2", day, "X", True, True, Decimal(50), Decimal(10), Decimal(0)),
            ("3", day, None, None, None, None, None, None)]
    claims = adjudicated(spark, rows)
    total = analytics.adjudication_summary(claims).first()
    assert [total[c] for c in ("total_claims", "approved_claims", "denied_claims", "unknown_adjudication_status_claims", "follow_up_required_claims")] == [3, 1, 1, 1, 1]
    assert (total["denial_rate_pct"], total["allowed_rate_pct"], total["paid_rate_pct"]) == (33.33, 60.0, 53.33)
    reasons = {r["denial_reason_code"]: (r["claim_count"], r["denied_billed_amount"]) for r in analytics.denial_reasons(claims).collect()}
    assert reasons == {"X": (1, 50.0), "NONE": (1, 0.0), "UNKNOWN": (1, 0.0)}
    funnel = {r["stage"]: r["amount"] for r in analytics.revenue_funnel(analytics.adjudication_summary(claims)).collect()}
    assert funnel == {"billed": 150.0, "allowed": 90.0, "paid": 80.0}
    empty = analytics.adjudication_summary(claims.limit(0)).first()
    assert empty["total_claims"] == 0 and empty["total_billed_amount"] is None and empty["denial_rate_pct"] is None
    assert analytics.revenue_by_date(claims).first()["denial_rate_pct"] == 33.33


def test_expectations_count_and_never_drop(spark):
    rows = spark.createDataFrame([("p", "d", None, None), (None, "d", "l", "bad")], "provider_id string, doctor_name string, location string, _rescued_data string")
    got = {r["expectation"]: (r["passed_records"], r["failed_records"]) for r in expectations.evaluate(rows, "providers").collect()}
    assert got == {"provider_id_not_null": (1, 1), "doctor_name_not_null": (2, 0), "location_present": (1, 1), "no_parse_errors": (1, 1)}
    null_verdict = expectations.evaluate(spark.createDataFrame([(None,)], "x int"), "t", {"positive": "x > 0"}).first()
    assert (null_verdict["passed_records"], null_verdict["failed_records"]) == (0, 1)
    assert sum(len(e) for e in expectations.EXPECTATIONS.values()) == 25


def test_null_profile_on_empty(spark):
    df = spark.createDataFrame([("a", " ", 1)], "x string, y string, _z int")
    assert {r["column"]: (r["null_count"], r["null_pct"]) for r in profiling.null_profile(df, "t").collect()} == {"x": (0, 0.0), "y": (1, 100.0)}
    assert {r["null_pct"] for r in profiling.null_profile(df.limit(0), "t").collect()} == {0.0}


def test_amounts_and_keys(spark):
    df = spark.createDataFrame([(str(i), Decimal(i)) for i in range(1, 101)] + [("1", None), (None, None)], "claim_id string, amount decimal(18,2)")
    row = profiling.amount_summary(df, F.col("amount")).first()
    assert (row["min_billed"], row["max_billed"], row["avg_billed"], row["p95_billed"], row["non_null_count"], row["is_anomaly"]) == (1.0, 100.0, 50.5, 95.0, 100, False)
    assert tuple(profiling.key_uniqueness(df, "claim_id").first()) == (102, 101, 1)
    assert [tuple(r) for r in profiling.most_duplicated(df, "claim_id").collect()] == [("1", 2)]
    nothing = profiling.amount_summary(df.limit(0), F.col("amount")).first()
    assert nothing["p95_billed"] is None and nothing["is_anomaly"] is False


def test_profiling_summary(spark):
    claims = spark.createDataFrame([("a", "p", None, "10"), ("a", "z", "x", None)], CLAIMS)
    providers = spark.createDataFrame([("p", None)], "provider_id string, location string")
    got = {r["question"]: r["result"] for r in profiling.summary(claims, providers, F.col("billed_amount").cast("decimal(18,2)"), skip=["Q5"]).collect()}
    assert got == {"Q1": "FAIL: 1 duplicate rows", "Q2": "50.00%", "Q3": "50.00%", "Q4": "FAIL: 1 orphans", "Q5": "NOT RUN", "Q6": "1"}


def test_privacy(spark):
    df = spark.createDataFrame([("P055", "x"), (None, "y")], "patient_id string, note string")
    assert [r["patient_id"] for r in privacy.protect(df, {"patient_id"}, privacy.MASK).collect()] == ["P***", None]
    assert len(privacy.protect(df, {"patient_id"}).first()["patient_id"]) == 64
    assert privacy.protect(df, {"patient_id"}, privacy.DROP).columns == ["note"]
    assert privacy.is_phi("claims", "patient_id") and not privacy.is_phi("claims", "claim_id") and not privacy.phi_columns("nothing")
    assert privacy.registry(Namespace())["bronze.claims"] == M.CLAIMS.phi and privacy.linkable_columns("claims") == M.CLAIMS.linkable


def test_drift(spark):
    base = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    same = drift.stability_index(drift.drift_buckets(base, base, "v")).first()
    assert same["psi"] == 0.0 and same["alert"] is False
    counts = drift.drift_buckets(base, base.where("v > 900"), "v").collect()
    assert sorted((r["bucket"], r["baseline_rows"], r["current_rows"]) for r in counts) == [(i, 100, 100 if i == 9 else 0) for i in range(10)]
    assert drift.stability_index(drift.drift_buckets(base, base.where("v > 900"), "v")).first()["alert"] is True


def test_flags(spark):
    names = ("is_procedure_missing", "is_amount_missing", "high_cost_flag", "severity_procedure_mismatch", "specialty_diagnosis_mismatch", "provider_location_missing")
    df = spark.createDataFrame([("a", True, False, True, False, None, False)], "claim_id string, " + ", ".join(f"{n} boolean" for n in names))
    assert tuple(claim_flags(df).first()) == ("a", ["missing_procedure_code", "over_benchmark"], 2)


@pytest.mark.parametrize("kept, held, alert", [(95, 5, False), (94, 6, True), (0, 0, False)])
def test_quarantine_alerts(spark, kept, held, alert):
    status = spark.createDataFrame([("claims", kept, held)], "dataset string, silver_row_count long, quarantine_row_count long")
    assert quality.quarantine_alerts(status).first()["alert"] is alert
