"""Exact quantiles and areas, the golden label value, and titles in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions.cleaning import title
from claimloom.operators import quantiles
from claimloom.operators.quantiles import BUCKETS, exact_quantiles, histogram
from claimloom.plans import labels
from claimloom.plans.modelling import roc_auc


def test_quantiles_equal_sorted_ranks(spark):
    rnd = random.Random(1)
    for values in ([rnd.gauss(0, 1) for _ in range(999)], [1e300, -1e300, 0.0, 5e-324, 1.0], [7.0] * 20, [rnd.randint(0, 3) + 1e-9 * rnd.randint(0, 5) for _ in range(200)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        shares = [0.05, 0.1, 0.3, 0.5, 0.95, 1.0]
        ordered = sorted(values)
        want = [ordered[max(1, -(-round(s * 100) * len(ordered) // 100)) - 1] for s in shares]
        assert exact_quantiles(df, "v", shares) == want
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_quantiles_with_infinities_and_without_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (-inf, 1.0, 2.0, inf, nan, None, -1.7e308, 1.7e308)], "v double")
    shares = [k / 6 for k in range(1, 7)]
    assert exact_quantiles(df, "v", [0.01, 0.2, 0.4, 0.6, 0.8, 1.0]) == [-inf, -1.7e308, 1.0, 2.0, 1.7e308, inf]
    assert exact_quantiles(df.where("isnan(v)"), "v", shares) == [None] * 6
    assert exact_quantiles(spark.createDataFrame([(inf,), (-inf,)], "v double"), "v", [0.5, 1.0]) == [-inf, inf]


@pytest.mark.parametrize("collected", [1 << 17, 0])
def test_brackets_of_many_rows_are_exact(spark, monkeypatch, collected):
    monkeypatch.setattr(quantiles, "COLLECTED", collected)
    rows = spark.range(200_000).select((F.hash("id") % 50_000 / 7.0).alias("v"))
    ordered = sorted(r["v"] for r in rows.collect())
    shares = [0.001, 0.05, 0.5, 0.95, 1.0]
    assert exact_quantiles(rows, "v", shares) == [ordered[round(s * 200_000) - 1] for s in shares]
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)  # brackets that miss are noticed
    assert exact_quantiles(rows, "v", [0.3, 0.7]) == [ordered[59_999], ordered[139_999]]


def test_a_pass_over_many_rows_returns_few(spark):
    counted = spark.range(4_000_000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    steps = histogram(counted, [(0.0, 3_999_999.0), (10.0, 20.0)])
    assert len(steps[(0.0, 3_999_999.0)]) <= BUCKETS and sum(n for _, _, n in steps[(0.0, 3_999_999.0)]) == 4_000_000
    assert exact_quantiles(spark.range(4_000_000).select(F.col("id").alias("v")), "v", [0.95]) == [3_799_999.0]


def test_area_of_scores_that_hardly_differ(spark):
    rows = [("a", 1.0, 0.5 + 1e-9 * (i + 1000)) for i in range(500)] + [("a", 0.0, 0.5 + 1e-9 * i) for i in range(900)]
    rows += [("b", float(i % 2), random.Random(i).random()) for i in range(600)] + [("c", 1.0, 0.3)]
    df = spark.createDataFrame(rows, "g string, label double, probability double").repartition(7)
    found = {r["g"]: r["roc_auc"] for r in roc_auc(df, ["g"]).collect()}
    b = [r for r in rows if r[0] == "b"]
    wins = [(p[2] > n[2]) + 0.5 * (p[2] == n[2]) for p in b if p[1] for n in b if not n[1]]
    assert found["a"] == 1.0 and found["b"] == pytest.approx(sum(wins) / len(wins), abs=1e-12) and found["c"] is None


def test_cost_not_above_zero_counts_as_none(spark):
    rows = [("p1", "100", cost, review) for cost in (0.0, -5.0, None) for review in (False, True)]
    df = spark.createDataFrame(rows, "procedure_code string, billed_amount string, expected_cost double, in_review boolean")
    df = df.withColumn("expected_cost", F.col("expected_cost").cast("decimal(18,2)"))
    out = [(r["in_review"], r["denial_reason_code"], str(r["allowed_amount"])) for r in labels.classified(df).collect()]
    assert set(out) == {(False, "NONE", "85.00"), (True, "MEDICAL_REVIEW", "60.00")}


def test_titles(spark):
    cases = {"dr jo md": "Dr Jo MD", "ob/gyn clinic": "OB/GYN Clinic", "mdx and pa-rn": "Mdx And PA-RN", " ent ": "ENT", "": None, "ob gyn": "Ob Gyn", "émd": "ÉMD"}
    df = spark.createDataFrame(list(cases.items()), "x string, want string")
    assert df.where(~title("x").eqNullSafe(F.col("want"))).count() == 0
