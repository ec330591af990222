import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from claimloom.model import FEATURES, GOLD_COLUMNS
from claimloom.operators.activity import provider_days
from claimloom.operators.lookups import lookup
from claimloom.plans import gold

CLAIMS = ("claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount decimal(18,2), "
          "date date, claim_status string, denial_reason_code string, allowed_amount decimal(18,2), paid_amount decimal(18,2), is_denied boolean, "
          "follow_up_required boolean, _ingested_at timestamp, _source_file string, _pipeline_run_id string, _silver_processed_at timestamp, _data_quality_flags array<string>")
AT = datetime.datetime(2024, 1, 1)


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def claim(i, provider="P1", code="D1", procedure="X1", billed="150", date=0, denied=False):
    return (i, "pt", provider, code, procedure, None if billed is None else Decimal(billed), None if date is None else day(date),
            "S", "NONE", None, None, denied, denied, AT, "f", "r", AT, [])


def build(spark, claims, **options):
    providers = spark.createDataFrame([("P1", "Heart", "Delhi"), ("P2", None, "Goa")], "provider_id string, specialty string, location string")
    diagnosis = spark.createDataFrame([("D1", "HEART", "High"), ("D2", "Bone", "Low"), ("D3", None, "Medium")], "diagnosis_code string, category string, severity string")
    cost = spark.createDataFrame([("X1", "Delhi", Decimal(80), Decimal(100)), ("X2", "Delhi", Decimal(4000), Decimal(5000)), ("X3", "Goa", Decimal(0), Decimal(0))],
                                 "procedure_code string, region string, average_cost decimal(18,2), expected_cost decimal(18,2)")
    df = spark.createDataFrame(claims, CLAIMS)
    return gold.gold_features(df, providers, diagnosis, cost, **options)


def test_claim_features(spark):
    rows = build(spark, [
        claim("a"), claim("b", billed="149.99"), claim("c", procedure="X2"), claim("d", procedure=None, billed=None, code="D2"),
        claim("e", provider="P9", code="D9"), claim("f", provider="P2", procedure="X3", code="D3", denied=True),
    ])
    assert rows.columns == list(GOLD_COLUMNS) and len(rows.columns) == 34
    assert not set(gold.OUTCOME_COLUMNS) & set(rows.columns)
    got = {r["claim_id"]: r for r in rows.collect()}
    assert got["a"]["amount_to_benchmark_ratio"] == 1.5 and got["a"]["high_cost_flag"] is True
    assert got["b"]["high_cost_flag"] is False and got["a"]["billed_vs_avg_cost"] == 1.875
    assert got["a"]["severity_procedure_mismatch"] is True and got["c"]["severity_procedure_mismatch"] is False
    assert got["a"]["specialty_diagnosis_mismatch"] is False and got["d"]["specialty_diagnosis_mismatch"] is True
    assert got["d"]["is_procedure_missing"] and got["d"]["is_amount_missing"] and got["d"]["amount_to_benchmark_ratio"] is None
    assert got["d"]["high_cost_flag"] is False and got["d"]["diagnosis_severity_encoded"] == 0
    assert got["e"]["provider_location_missing"] is True and got["e"]["specialty_diagnosis_mismatch"] is None
    assert got["f"]["amount_to_benchmark_ratio"] is None and got["f"]["diagnosis_severity_encoded"] is None
    assert got["f"]["denial_label"] == 1 and got["a"]["denial_label"] == 0


def test_provider_activity(spark):
    claims = [claim("a", date=0), claim("b", date=30, code="D2"), claim("c", date=31, denied=True), claim("d", date=31), claim("e", provider=None),
              claim("f", provider="P2", date=None)]
    got = {r["claim_id"]: r for r in build(spark, claims).collect()}
    assert [got[i]["provider_claim_count_30d"] for i in "abcdef"] == [1, 2, 3, 3, None, None]
    assert got["a"]["provider_claim_count"] == 4 and got["a"]["provider_risk_score"] == 0.25 and got["a"]["diagnosis_count"] == 2
    assert got["e"]["provider_claim_count"] is None and got["e"]["diagnosis_count"] is None
    assert got["f"]["provider_claim_count"] == 1


def test_trailing_window_against_brute_force(spark):
    days = [(i * 7919) % 200 for i in range(300)]
    claims = [claim(str(i), provider=f"P{i % 3}", date=d) for i, d in enumerate(days)]
    got = {(r["provider_id"], r["date"]): r["provider_claim_count_30d"] for r in provider_days(spark.createDataFrame(claims, CLAIMS), 30).collect()}
    for i, d in enumerate(days):
        expected = sum(1 for j, e in enumerate(days) if j % 3 == i % 3 and d - 30 <= e <= d)
        assert got[(f"P{i % 3}", day(d))] == expected


def test_salted_form_gives_the_same_rows(spark, small_broadcasts_off):
    claims = [claim(str(i), provider="P1" if i % 3 else "P2", date=i % 50, code=f"D{i % 4}") for i in range(200)]
    salted = build(spark, claims, as_of=F.lit(AT))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    plain = build(spark, claims, as_of=F.lit(AT))
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_no_claims(spark):
    assert build(spark, []).count() == 0


def test_features_are_in_the_table():
    assert set(FEATURES) <= set(GOLD_COLUMNS) and len(FEATURES) == 13


def test_claims_are_shuffled_three_times_at_most(spark, small_broadcasts_off):
    """Exchanges below a join with the allowed columns carry whole claims: provider and day, diagnosis, cost."""
    claims = spark.createDataFrame([], "claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, "
                                       "billed_amount decimal(18,2), date date, is_denied boolean")
    providers = spark.createDataFrame([], "provider_id string, specialty string, location string")
    diagnosis = spark.createDataFrame([], "diagnosis_code string, category string, severity string")
    cost = spark.createDataFrame([], "procedure_code string, region string, average_cost decimal(18,2), expected_cost decimal(18,2)")
    rows = gold._with_benchmarks(lookup(claims, lookup(provider_days(claims, 30), providers, ["provider_id"]), ["provider_id", "date"], ["date"]), diagnosis, cost)
    assert rows.columns.count("provider_id") == 1
    joins = str(rows._jdf.queryExecution().optimizedPlan().toString()).count("Join LeftOuter")
    assert joins == 5  # three of claims; two of provider-days


def test_a_hot_key_is_split(spark, small_broadcasts_off):
    from claimloom.session import configure

    keys = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("256k", "256k", "16")):
            spark.conf.set(k, v)
        configure(spark)
        rows = spark.range(600_000, numPartitions=8).selectExpr("if(id % 3 = 0, -1, id % 5000) AS k", "uuid() AS v")
        table = spark.range(-1, 5000).selectExpr("id AS k", "id AS x")
        sizes = [r["n"] for r in lookup(rows, table, on=["k"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("v")).collect()]
        assert sum(sizes) == 600_000 and max(sizes) <= 100_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_undated_claims_meet_their_providers_activity(spark):
    claims = spark.createDataFrame(
        [("a", "p", None), ("b", "p", "2024-01-01"), ("c", None, None), ("d", "q", None), ("e", "p", None)], "claim_id string, provider_id string, date string",
    ).select("claim_id", "provider_id", F.to_date("date").alias("date"), F.lit("x").alias("diagnosis_code"), F.lit("y").alias("procedure_code"),
             F.lit(1).cast("decimal(18,2)").alias("billed_amount"), F.lit(False).alias("is_denied"))
    providers = spark.createDataFrame([("p", "Heart", "Here")], "provider_id string, specialty string, location string")
    diagnosis = spark.createDataFrame([("x", "Heart", "High")], "diagnosis_code string, category string, severity string")
    cost = spark.createDataFrame([("y", "Here")], "procedure_code string, region string").withColumns({c: F.lit(1).cast("decimal(18,2)") for c in ("average_cost", "expected_cost")})
    columns = ("claim_id", "provider_claim_count", "provider_claim_count_30d", "specialty")
    found = {r[0]: tuple(r)[1:] for r in gold.gold_features(claims, providers, diagnosis, cost, columns=columns).collect()}
    assert found == {"a": (3, None, "Heart"), "b": (3, 1, "Heart"), "c": (None, None, None), "d": (1, None, None), "e": (3, None, "Heart")}
