import pytest
from pyspark.sql import functions as F

from claimloom.model import FEATURES
from claimloom.plans import modelling as ML


@pytest.fixture(scope="module")
def frame(spark):
    """Model-shaped rows whose label follows two of the inputs."""
    u = lambda seed: F.rand(seed)
    df = spark.range(1200).repartition(2).select(
        F.concat(F.lit("C"), "id").alias("claim_id"),
        *((u(i) < 0.5).alias(c) for i, c in enumerate(FEATURES) if c.startswith(("is_", "high", "severity", "provider_location"))),
        F.when(u(20) < 0.1, None).otherwise(u(21) < 0.5).alias("specialty_diagnosis_mismatch"),
        (u(30) * 2.5 + 0.5).alias("amount_to_benchmark_ratio"), (u(31) * 2 + 0.5).alias("billed_vs_avg_cost"),
        F.when(u(32) < 0.2, None).otherwise((u(33) * 2).cast("int")).alias("diagnosis_severity_encoded"),
        (u(34) * 8 + 1).cast("int").alias("diagnosis_count"), (u(35) * 49 + 1).cast("int").alias("provider_claim_count"),
        (u(36) * 20).cast("int").alias("provider_claim_count_30d"), (u(37) * 0.8).alias("provider_risk_score"))
    return df.withColumn("denial_label", (F.col("amount_to_benchmark_ratio") + F.col("provider_risk_score") > 2.4).cast("int")).cache()


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "label int, probability double")


def test_missing_inputs_are_filled(spark, frame):
    ready = ML.training_frame(frame)
    assert ready.columns == ["claim_id", *FEATURES, "denial_label"]
    assert ready.where(" OR ".join(f"{c} IS NULL" for c in FEATURES)).count() == 0
    row = spark.createDataFrame([(None, None)], "diagnosis_count int, provider_risk_score double")
    assert tuple(ML.fill_features(row).first()) == (1, 0.0)


def test_split_is_stable_and_balanced(frame):
    train, test = ML.split(frame)
    assert train.count() + test.count() == 1200 and train.join(test, "claim_id", "left_semi").count() == 0
    assert abs(test.count() / 1200 - 0.3) < 0.05
    rates = [df.agg(F.avg("denial_label")).first()[0] for df in (train, test)]
    assert abs(rates[0] - rates[1]) < 0.05
    again = ML.split(frame.repartition(5))[1]
    assert again.select("claim_id").exceptAll(test.select("claim_id")).count() == 0


@pytest.mark.parametrize("p, tier", [(0.1, "LOW"), (0.3, "MEDIUM"), (0.5, "MEDIUM"), (0.7, "HIGH"), (0.9, "HIGH")])
def test_tiers(spark, p, tier):
    assert spark.range(1).select(ML.risk_tier(F.lit(p)).alias("t")).first()["t"] == tier


def test_recall_at_high(spark):
    assert ML.recall_at_high(scores(spark, [(1, .95), (1, .55), (0, .10), (0, .40)])).first()[0] == 0.5
    assert ML.recall_at_high(scores(spark, [(0, .95)])).first()[0] == 0.0
    assert ML.recall_at_high(scores(spark, []).limit(0)).first()[0] == 0.0


def test_metrics(spark):
    row = ML.evaluate(scores(spark, [(1, .9), (1, .8), (1, .2), (0, .6), (0, .1), (0, .2)])).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 1, 1, 2)
    assert row["accuracy"] == pytest.approx(4 / 6) and row["precision"] == pytest.approx(2 / 3) and row["f1"] == pytest.approx(2 / 3)
    assert row["roc_auc"] == pytest.approx((3 + 3 + 1.5) / 9)
    nothing = ML.evaluate(scores(spark, [(0, .1), (0, .2)])).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"], nothing["roc_auc"]) == (0.0, 0.0, 0.0, None)


def test_auc_matches_pairwise_count(spark):
    pairs = [(int(i * 37 % 11 < 4), round((i * 53 % 101) / 100, 2)) for i in range(150)]
    wins = [(p > n) + 0.5 * (p == n) for a, p in pairs if a for b, n in pairs if not b]
    assert ML.roc_auc(scores(spark, pairs)).first()[0] == pytest.approx(sum(wins) / len(wins))


def test_gate_uses_recall_at_high(spark):
    metrics = spark.createDataFrame([
        ("a", .90, .50, .9, .9), ("b", .85, .80, .70, .85), ("c", .99, .99, .69, .99), ("d", .9, .9, .9, None), ("e", .85, .85, .75, .9)],
        "model_name string, recall double, recall_at_high double, precision double, roc_auc double")
    got = {r[0]: r[1] for r in metrics.select("model_name", ML.passes_gate()).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False, "e": True}
    assert [r["model_name"] for r in ML.rank_models(metrics).collect()] == ["e", "b", "c", "d", "a"]
    assert ML.best_model(metrics).first()["model_name"] == "e"


def test_training_scoring_and_release(spark, frame, tmp_path):
    path = str(tmp_path / "model")
    model, name, ranked = ML.train_and_select(frame, path, boosted={"maxIter": 5, "maxDepth": 3})
    assert name in ("boosted_trees", "logistic_regression") and len(ranked) == 2 and ranked[0]["roc_auc"] > 0.9
    predictions = ML.score(model, frame)
    assert predictions.columns == ["claim_id", "denial_probability", "risk_level"] and predictions.count() == 1200
    assert predictions.where("denial_probability NOT BETWEEN 0 AND 1").count() == 0
    audit = ML.prediction_audit(predictions, "v1")
    assert audit.columns == ["claim_id", "model_version", "denial_probability", "risk_level", "scored_at"]
    good = spark.createDataFrame([(1.0, 1.0, 1.0)], "recall_at_high double, precision double, roc_auc double")
    assert ML.save_if_good(model, good, path) and ML.score(ML.load(path), frame).exceptAll(predictions).count() == 0
    assert not ML.save_if_good(model, good.withColumn("precision", F.lit(0.1)), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_attribution(spark, frame):
    ready = ML.training_frame(frame)
    model = ML.fit_logistic(ready, maxIter=20)
    coefficients = ML.coefficients_of(model)
    means = ready.agg(*(F.avg(c).alias(c) for c in FEATURES))
    out = ML.contributions(ready, coefficients, means)
    row = out.first()
    assert len(row["top_features"]) == 3 and "amount_to_benchmark_ratio" in row["top_features"] + out.collect()[1]["top_features"]
    total = out.agg(F.avg("contribution_provider_risk_score")).first()[0]
    assert total == pytest.approx(0.0, abs=1e-9)
    assert ML.feature_means(ready)["provider_risk_score"] == pytest.approx(means.first()["provider_risk_score"])


def test_boosted_importances_and_tuning(frame):
    ready = ML.training_frame(frame)
    weights = ML.importances_of(ML.fit_boosted(ready, maxIter=3, maxDepth=3))
    assert max(weights, key=weights.get) in ("amount_to_benchmark_ratio", "provider_risk_score")
    _, best = ML.tune_boosted(ready, depths=(1, 3), steps=(0.1,), rounds=(2,), folds=2)
    assert best["maxDepth"] == 3


def test_report(spark):
    metrics = ML.evaluate(scores(spark, [(1, .9), (0, .1)]))
    row = ML.report(metrics, "m").first()
    assert row["confusion_matrix"].asDict() == {"true_negatives": 1, "false_positives": 0, "false_negatives": 0, "true_positives": 1}
    assert row["meets_thresholds"] is True and row["feature_count"] == 13 and row["features"] == list(FEATURES)
