"""The denial model on Spark ML: inputs, split, fitting, evaluation, gate and batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import FEATURE_FILL, FEATURES, TARGET
from claimloom.sinks import stage

# Split, tiers, release gate and default training parameters.
TEST_SHARE = 0.3
SEED = 42
LOW_BELOW = 0.3
HIGH_FROM = 0.7
GATE = {"recall_at_high": 0.80, "precision": 0.70, "roc_auc": 0.85}
LOGISTIC = {"maxIter": 1000}
BOOSTED = {"maxDepth": 6, "stepSize": 0.1, "maxIter": 100, "seed": SEED}
POSITIVE_WEIGHT = 2.5
#: Rows of a training partition, and rows enough for one in a search, whose many short jobs cost more than their rows.
ROWS_PER_TASK, SEARCH_ROWS = 250_000, 25_000


def fill_features(df: DataFrame, fill: Mapping[str, float] = FEATURE_FILL) -> DataFrame:
    """Replace missing inputs; booleans become 0 or 1. Columns that are not inputs pass through."""
    def filled(name: str) -> Column:
        kind = "double" if isinstance(fill[name], float) else "int"
        return F.coalesce(F.col(name).cast(kind), F.lit(fill[name]).cast(kind))

    return df.withColumns({name: filled(name) for name in fill if name in df.columns})


def training_frame(gold: DataFrame, keep: Sequence[str] = ("claim_id",)) -> DataFrame:
    """The model's inputs and target, complete and numeric, with the ``keep`` columns in front."""
    return fill_features(gold).select(*keep, *FEATURES, F.col(TARGET).cast("int").alias(TARGET))


def holdout(key: Column, seed: int = SEED, share: float = TEST_SHARE) -> Column:
    """True for about ``share`` of the keys: a fixed function of key and seed, without a shuffle.

    Keys are dealt independently of the label, so either side keeps the class balance up to
    sampling noise, and a rerun or a lost executor cannot move a row across.
    """
    digest = F.sha2(F.concat(key.cast("string"), F.lit(f"|{seed}")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) < share


def split(frame: DataFrame, key: str = "claim_id") -> tuple[DataFrame, DataFrame]:
    held = holdout(F.col(key))
    return frame.where(~held), frame.where(held)


def class_weights(frame: DataFrame) -> dict[int, float]:
    """n / (2 · n of the class), from one two-row aggregate."""
    counts = {row[TARGET]: row["n"] for row in frame.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {label: total / (len(counts) * n) for label, n in counts.items()}


def _weighted(frame: DataFrame, weights: Mapping[int, float]) -> DataFrame:
    pairs = [F.lit(x) for label, weight in weights.items() for x in (label, float(weight))]
    return frame.withColumn("_weight", F.create_map(*pairs)[F.col(TARGET)])


def dealt(frame: DataFrame, rows: int = ROWS_PER_TASK, least: int = 1) -> DataFrame:
    """The rows in partitions of about ``rows``, for fits that keep each partition in memory and pass over it many times.

    A split of a stored table holds the more rows the narrower they are, so its size in memory would have no bound.
    All cores get a partition unless these would hold fewer than ``least`` rows.
    """
    held = frame.count()
    tasks = max(1, min(frame.sparkSession.sparkContext.defaultParallelism, -(-held // least)), -(-held // rows))
    return frame.repartition(tasks)


def _stages(classifier) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), classifier])


def fit_logistic(train: DataFrame, **params) -> PipelineModel:
    """Class-balanced logistic regression."""
    model = LogisticRegression(labelCol=TARGET, weightCol="_weight", **{**LOGISTIC, **params})
    return _stages(model).fit(_weighted(dealt(train), class_weights(train)))


def fit_boosted(train: DataFrame, positive_weight: float = POSITIVE_WEIGHT, **params) -> PipelineModel:
    """Gradient-boosted trees with the denied class weighted up."""
    model = GBTClassifier(labelCol=TARGET, weightCol="_weight", **{**BOOSTED, **params})
    return _stages(model).fit(_weighted(dealt(train), {0: 1.0, 1: positive_weight}))


def tune_boosted(
    train: DataFrame,
    depths: Sequence[int] = (3, 6, 10),
    steps: Sequence[float] = (0.03, 0.1, 0.3),
    rounds: Sequence[int] = (50, 100),
    folds: int = 5,
    parallelism: int = 4,
    positive_weight: float = POSITIVE_WEIGHT,
) -> tuple[PipelineModel, dict[str, float]]:
    """Cross-validated grid search by ROC AUC; the best model and its parameters."""
    tree = GBTClassifier(labelCol=TARGET, weightCol="_weight", seed=SEED)
    grid = (
        ParamGridBuilder()
        .addGrid(tree.maxDepth, list(depths))
        .addGrid(tree.stepSize, list(steps))
        .addGrid(tree.maxIter, list(rounds))
        .build()
    )
    search = CrossValidator(
        estimator=_stages(tree),
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol=TARGET),
        numFolds=folds,
        parallelism=parallelism,
        seed=SEED,
    )
    found = search.fit(_weighted(dealt(train, least=SEARCH_ROWS), {0: 1.0, 1: positive_weight}))
    best = max(range(len(grid)), key=lambda i: found.avgMetrics[i])
    return found.bestModel, {p.name: v for p, v in grid[best].items()}


def risk_tier(probability: Column) -> Column:
    return F.when(probability < LOW_BELOW, "LOW").when(probability < HIGH_FROM, "MEDIUM").otherwise("HIGH")


def score(model: PipelineModel, gold: DataFrame, keep: Sequence[str] = ("claim_id",)) -> DataFrame:
    """Denial probability and risk tier per row."""
    probability = vector_to_array(F.col("probability"))[1]
    rows = model.transform(fill_features(gold).select(*dict.fromkeys([*keep, *FEATURES])))
    return rows.select(*keep, probability.alias("denial_probability")).withColumn(
        "risk_level", risk_tier(F.col("denial_probability"))
    )


def scored(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """``(label, probability)`` of a labelled frame, for evaluation."""
    return score(model, frame, keep=("claim_id", TARGET)).select(
        F.col(TARGET).alias("label"), F.col("denial_probability").alias("probability")
    )


def prediction_audit(scores: DataFrame, model_version: str, at: Column | None = None) -> DataFrame:
    """Append-only record of what was predicted, by which model, and when."""
    return scores.select(
        "claim_id", F.lit(model_version).alias("model_version"), "denial_probability", "risk_level",
        (F.current_timestamp() if at is None else at).alias("scored_at"),
    )


def confusion(scores: DataFrame, groups: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp per group from one conditional aggregate."""
    called, actual = F.col("probability") > threshold, F.col("label") == 1
    return scores.groupBy(*groups).agg(
        F.count_if(~actual & ~called).alias("tn"),
        F.count_if(~actual & called).alias("fp"),
        F.count_if(actual & ~called).alias("fn"),
        F.count_if(actual & called).alias("tp"),
        F.count_if(actual & (F.col("probability") >= HIGH_FROM)).alias("tp_high"),
    )


def _confusion_of(counts: DataFrame, groups: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """What :func:`confusion` gives, from the counts of distinct scores; a NULL score counts nowhere in either."""
    def total(count: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(count))), F.lit(0).cast("long"))

    called = F.col("_score") > threshold
    return counts.groupBy(*groups).agg(
        total("_n", ~called).alias("tn"), total("_n", called).alias("fp"),
        total("_p", ~called).alias("fn"), total("_p", called).alias("tp"),
        total("_p", F.col("_score") >= HIGH_FROM).alias("tp_high"),
    )


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def recall_at_high(scores: DataFrame) -> DataFrame:
    """Share of the positives that reach the HIGH tier; 0 without positives."""
    counts = confusion(scores)
    return counts.select(_or_zero(F.col("tp_high"), F.col("tp") + F.col("fn")).alias("recall_at_high"))


def roc_auc(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per group; equal scores count half.

    Rows are counted per distinct score, the counts are ranged over partitions by score and stored, and
    each partition adds the negatives of the partitions below it, one row each, to its own running sum.
    """
    return _area(_score_counts(scores, groups), groups)


def _score_counts(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives of every distinct score, ranged by score and stored: the only pass over the scores."""
    counted = scores.where(F.col("probability").isNotNull()).groupBy(*groups, F.col("probability").alias("_score")).agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") != 1).alias("_n")
    )
    return stage(counted.repartitionByRange(*groups, "_score").withColumn("_part", F.spark_partition_id()), "score-ranges", codec="zstd")


def _area(ranged: DataFrame, groups: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_all")).select(
        *groups, "_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_below")
    )
    inside = Window.partitionBy(*groups, "_part").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_run", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(parts, [*groups, "_part"])
    wins = F.col("_p") * ((F.col("_below") + F.col("_run")) * 2 + F.col("_n"))
    return placed.groupBy(*groups).agg(
        F.try_divide(
            F.sum(wins.cast("decimal(38,0)")).cast("double"), F.sum("_p").cast("double") * F.sum("_n").cast("double") * 2.0
        ).alias("roc_auc")
    )


def evaluate(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC AUC, recall at HIGH and the confusion counts per group.

    All of it follows from the counts of distinct scores, so the scores are made once.
    """
    counts = _score_counts(scores, groups)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    measures = _confusion_of(counts, groups).select(
        *groups,
        _or_zero(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero(tp * 2, tp * 2 + fp + fn).alias("f1"),
        _or_zero(F.col("tp_high"), tp + fn).alias("recall_at_high"),
        "tn", "fp", "fn", "tp",
    )
    area = _area(counts, groups)
    if groups:
        return measures.join(area, list(groups))
    one = F.lit(1).alias("_one")
    return measures.select("*", one).join(area.select("*", one), "_one").drop("_one")


def passes_gate(minimum: Mapping[str, float] = GATE) -> Column:
    verdict = F.lit(True)
    for metric, floor in minimum.items():
        verdict = verdict & F.coalesce(F.col(metric) >= floor, F.lit(False))
    return verdict


def rank_models(metrics: DataFrame) -> DataFrame:
    """Candidates best first: those through the gate, then recall at HIGH, then ROC AUC."""
    return metrics.withColumn("meets_thresholds", passes_gate()).orderBy(
        F.desc("meets_thresholds"), F.desc("recall_at_high"), F.desc("roc_auc"), F.asc("model_name")
    )


def best_model(metrics: DataFrame) -> DataFrame:
    return rank_models(metrics).limit(1)


def report(metrics: DataFrame, model_name: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """The evaluation of one model as one structured row."""
    counts = {"true_negatives": "tn", "false_positives": "fp", "false_negatives": "fn", "true_positives": "tp"}
    return metrics.select(
        F.lit(model_name).alias("model_name"),
        "accuracy", "precision", "recall", "recall_at_high", "f1", "roc_auc",
        F.struct(*(F.col(c).alias(name) for name, c in counts.items())).alias("confusion_matrix"),
        passes_gate().alias("meets_thresholds"),
        F.lit(len(features)).alias("feature_count"),
        F.array(*map(F.lit, features)).alias("features"),
    )


def save_if_good(model: PipelineModel, metrics: DataFrame, path: str) -> bool:
    """Write the model only when its metrics pass the gate; returns whether it was written."""
    passed = metrics.select(passes_gate().alias("ok")).first()
    if passed is None or not passed["ok"]:
        return False
    model.write().overwrite().save(path)
    return True


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_and_select(gold: DataFrame, path: str | None = None, boosted: Mapping | None = None, logistic: Mapping | None = None):
    """Fit both models, evaluate them on the held-out rows, and keep the better one.

    Returns the chosen model, its name and the ranked metrics; writes it to ``path`` if it passes.
    """
    train, test = split(training_frame(gold))
    models = {
        "boosted_trees": fit_boosted(train, **(boosted or {})),
        "logistic_regression": fit_logistic(train, **(logistic or {})),
    }
    scores = None
    for name, model in models.items():
        rows = scored(model, test).withColumn("model_name", F.lit(name))
        scores = rows if scores is None else scores.unionByName(rows)
    ranked = rank_models(evaluate(scores, ["model_name"])).collect()
    winner = ranked[0]
    if path is not None and winner["meets_thresholds"]:
        models[winner["model_name"]].write().overwrite().save(path)
    return models[winner["model_name"]], winner["model_name"], ranked


def feature_means(frame: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, float]:
    return frame.agg(*(F.avg(c).alias(c) for c in features)).first().asDict()


def contributions(frame: DataFrame, coefficients: Mapping[str, float], means: DataFrame, top: int = 3) -> DataFrame:
    """Linear attribution: coefficient · (value − mean) per input, and the ``top`` strongest names.

    ``means`` is one row with a column per input.
    """
    names = list(coefficients)
    averages = means.select(*(F.col(c).alias(f"_mean_{c}") for c in names), F.lit(1).alias("_one"))
    rows = frame.withColumn("_one", F.lit(1)).join(F.broadcast(averages), "_one").drop("_one")
    parts = {c: F.lit(float(w)) * (F.col(c) - F.col(f"_mean_{c}")) for c, w in coefficients.items()}
    ranked = F.array_sort(F.array(*(
        F.struct((-F.abs(v)).alias("size"), F.lit(c).alias("name")) for c, v in parts.items()
    )))
    return rows.select(
        "claim_id",
        *(v.alias(f"contribution_{c}") for c, v in parts.items()),
        F.transform(F.slice(ranked, 1, top), lambda s: s["name"]).alias("top_features"),
    )


def coefficients_of(model: PipelineModel) -> dict[str, float]:
    return dict(zip(FEATURES, (float(c) for c in model.stages[-1].coefficients)))


def importances_of(model: PipelineModel) -> dict[str, float]:
    return dict(zip(FEATURES, (float(v) for v in model.stages[-1].featureImportances)))
