"""How often the claim plans read and shuffle what they are made from."""

import pytest
from pyspark.sql import functions as F

from claimloom.plans import modelling
from claimloom.sources.testbed import MODEL_COLUMNS, Layers


@pytest.fixture(scope="module")
def layers(spark):
    return Layers(spark, "/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_validation_reads_landed_claims_and_joins_no_sources(layers):
    validated = plan(layers.validated("claims"))
    assert "l_orderkey" not in validated and "o_orderkey" not in validated


def test_some_columns_of_the_features_are_those_of_the_whole_table(layers):
    whole, some = layers.gold(), layers.gold(columns=MODEL_COLUMNS)
    assert tuple(some.columns) == MODEL_COLUMNS
    assert "_source_file" not in layers.stored_claims(MODEL_COLUMNS).columns
    assert some.exceptAll(whole.select(*MODEL_COLUMNS)).isEmpty() and some.count() == whole.count()


def test_evaluation_reads_the_scores_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    spark.createDataFrame(
        [("a", 1, 0.9), ("a", 0, 0.2), ("a", 1, 0.2), ("a", 0, None), ("b", 0, 0.7), ("b", 1, 0.7), ("b", None, 0.1), ("b", 1, float("nan"))],
        "m string, label int, probability double").write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(p):
        reads.add(1)
        return p

    scores = spark.read.parquet(path).withColumn("probability", seen.asNondeterministic()("probability"))
    found = {r["m"]: r for r in modelling.evaluate(scores, ["m"]).collect()}
    assert reads.value == 8
    counts = {r["m"]: r for r in modelling.confusion(spark.read.parquet(path), ["m"]).collect()}
    for name, row in found.items():
        assert [row[c] for c in ("tn", "fp", "fn", "tp")] == [counts[name][c] for c in ("tn", "fp", "fn", "tp")]
    assert found["a"]["roc_auc"] == 0.75


def test_training_partitions_are_bounded_by_rows(spark):
    frame = spark.range(0, 10_000, 1, 1).select("id")
    sizes = [r["count"] for r in modelling.dealt(frame, rows=500).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 20 and max(sizes) <= 520


def test_summaries_of_judged_rows_read_no_claim_columns(layers):
    from oracle.registry import QUERIES, _judged

    found = {r["table_name"]: r["row_count"] for r in QUERIES["ops8_quality_tables"].build(layers).collect()}
    hit = sum(f.where("_failure IS NOT NULL").select("_failure.rule_name").distinct().count() for f in _judged(layers).values())
    assert found == {"ops_silver_table_status": 5, "ops_quarantine_summary": hit}


def test_drift_reads_stored_claims_on_both_sides(layers):
    from oracle.registry import QUERIES

    drifted = plan(QUERIES["lbl5_label_drift"].build(layers))
    assert "Window" not in drifted and "l_shipdate" not in drifted


def test_the_tuning_query_searches_the_whole_grid(layers, monkeypatch):
    import inspect

    from oracle.registry import QUERIES

    asked, whole = [], inspect.signature(modelling.tune_boosted)
    found = {"maxDepth": 6, "stepSize": 0.1, "maxIter": 100}

    def search(*args, **kwargs):
        call = whole.bind(*args, **kwargs)
        call.apply_defaults()
        asked.append(call.arguments)
        return None, found

    monkeypatch.setattr(modelling, "tune_boosted", search)
    rows = QUERIES["ml7_tuned_parameters"].build(layers).collect()
    assert {r["parameter"]: r["value"] for r in rows} == found
    (call,) = asked
    assert (call["depths"], call["steps"], call["rounds"], call["folds"]) == ((3, 6, 10), (0.03, 0.1, 0.3), (50, 100), 5)


def test_searches_of_few_rows_are_not_cut_into_tiny_partitions(spark):
    frame = spark.range(0, 1000, 1, 4)
    assert modelling.dealt(frame, least=400).rdd.getNumPartitions() == 3
    assert modelling.dealt(frame, least=2000).rdd.getNumPartitions() == 1
    assert modelling.dealt(frame, rows=100, least=2000).rdd.getNumPartitions() == 10
    assert modelling.dealt(frame.limit(0)).rdd.getNumPartitions() >= 1


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_contest_of_landed_claims_shuffles_nothing(layers):
    found = physical(layers.validated("claims"))
    assert "Exchange hashpartitioning(claim_id" not in found and "Bucketed: true" in found


def test_claims_meet_their_activity_where_they_lie(layers, small_broadcasts_off):
    found = physical(layers.gold())
    # What is shuffled to the claims has a row for each provider and day; the claims' own columns stay.
    scans = [line for line in found.splitlines() if "FileScan" in line and "patient_id" in line]
    assert scans and all("Bucketed: true" in line for line in scans)


@pytest.fixture()
def stored(monkeypatch):
    """The columns of what a query stores itself."""
    import oracle.registry as registry

    found = {}

    def kept(df, name, *args, **kwargs):
        found[name] = df.columns
        return df

    monkeypatch.setattr(registry, "stage", kept)
    return found


def test_lineage_stores_what_it_reads(layers, stored):
    from oracle.registry import QUERIES

    QUERIES["anl15_claim_lineage"].build(layers)
    assert stored["validated_claims"] == ["claim_id", "_ingested_at", "_silver_processed_at", "_failure"]


def test_summaries_read_the_landed_claims_they_stored(layers, stored):
    from oracle.registry import QUERIES

    sizes = QUERIES["anl16_all_summaries"].build(layers)
    assert "_row_id" not in stored["validated_claims"]
    assert "l_orderkey" not in plan(sizes) and "o_orderkey" not in plan(sizes)


def test_bucketed_stages_are_read_without_the_catalog(spark):
    from claimloom.sinks import scratch, stage_bucketed

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    before = {t.name for t in spark.catalog.listTables()}
    with scratch(spark):
        kept = stage_bucketed(rows, "kept", 3, ("k",), "zstd")
        assert {t.name for t in spark.catalog.listTables()} == before
        assert kept.exceptAll(rows).isEmpty() and kept.count() == 1000
        (path,) = {p.rsplit("/", 1)[0] for p in kept.inputFiles()}
        assert "Exchange" not in physical(kept.groupBy("k").count())
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
