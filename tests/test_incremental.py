"""Silver by changed key buckets: the same rows as a whole refresh, and no file of another bucket touched."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimloom.functions import cleaning as C
from claimloom.model import BATCH, ROW_ID
from claimloom.namespace import Namespace
from claimloom.plans import incremental, silver
from claimloom.sinks import replace_partitions
from claimloom.sources.testbed import Layers
from tests.conftest import SMALL

BUCKETS = 8


@pytest.fixture()
def land(spark):
    """Lands rows of the test bed as one batch of a Bronze table, in a namespace of its own."""
    names = Namespace(prefix="changes_")
    names.create(spark, ("bronze", "silver", "quarantine"))
    layers = Layers(spark, SMALL)

    def put(dataset, batch, condition="true"):
        rows = layers.raw(dataset).where(condition).withColumn(BATCH, F.lit(batch))
        replace_partitions(rows, names.bronze(dataset), (BATCH,))

    yield names, layers, put
    for layer in ("bronze", "silver", "quarantine"):
        spark.sql(f"DROP DATABASE {names.database(layer)} CASCADE")


def rows_of(df):
    return Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def files_of(spark, table):
    """Files of a table by bucket, with what tells a rewritten one."""
    found = {}
    for path in spark.read.table(table).inputFiles():
        local = path.removeprefix("file:").replace("///", "/")
        found.setdefault(int(local.split(f"{incremental.BUCKET}=")[1].split("/")[0]), set()).add((local, os.stat(local).st_mtime_ns))
    return found


def whole(layers, names, spark, dataset, now):
    """The rows of all landed batches, validated together."""
    landed = {n: spark.read.table(names.bronze(n)).drop(BATCH) for n in incremental.ORDER if spark.catalog.tableExists(names.bronze(n))}
    if dataset == "claims":
        checked = silver.validated_claims(landed["claims"], landed["providers"], landed["diagnosis"], now)
    else:
        checked = getattr(silver, f"validated_{dataset}")(landed[dataset], now)
    return silver.trusted_rows(checked), silver.quarantined_rows(checked, dataset, now)


def equal_to_whole(spark, names, layers, now):
    for dataset in incremental.ORDER:
        for kept, table in zip(whole(layers, names, spark, dataset, now), (names.silver(dataset), names.quarantine(dataset))):
            assert rows_of(incremental.refreshed(spark, table).drop(ROW_ID)) == rows_of(kept.drop(ROW_ID)), table


def test_batches_equal_a_whole_refresh(spark, land):
    names, layers, put = land
    part = f"pmod(xxhash64({ROW_ID}), 3)"
    for batch in range(3):
        for dataset in incremental.ORDER:
            put(dataset, batch, f"{part} = {batch}")
        touched = incremental.refresh_changes(spark, names, BUCKETS, layers.as_of)
        assert all(touched.values())
        equal_to_whole(spark, names, layers, layers.as_of)
    assert incremental.pending(spark, names) == {n: [] for n in incremental.ORDER}
    assert incremental.refresh_changes(spark, names, BUCKETS, layers.as_of) == {n: [] for n in incremental.ORDER}


def test_only_touched_buckets_are_read_and_written(spark, land):
    names, layers, put = land
    key = C.code("provider_id")
    known = layers.raw("providers").select(key.alias("k")).intersect(layers.raw("claims").select(key.alias("k"))).where("k IS NOT NULL")
    missing = key == known.orderBy("k").first()["k"]
    for dataset in incremental.ORDER:
        put(dataset, 0, F.coalesce(~missing, F.lit(True)) if dataset == "providers" else "true")
    incremental.refresh_changes(spark, names, BUCKETS, layers.as_of)
    tables = [t(d) for d in incremental.ORDER for t in (names.silver, names.quarantine)]
    before = {t: files_of(spark, t) for t in tables}

    # One claim lands again.
    again = layers.raw("claims").where("claim_id IS NOT NULL").orderBy(ROW_ID).first()[ROW_ID]
    put("claims", 1, f"{ROW_ID} = '{again}'")
    touched = incremental.refresh_changes(spark, names, BUCKETS, layers.as_of)
    assert len(touched["claims"]) == 1 and not (touched["providers"] or touched["diagnosis"] or touched["cost"])
    read = incremental._bucket_rows(spark, names, "claims", touched["claims"]).inputFiles()
    assert read and all(f"{incremental.BUCKET}={touched['claims'][0]}/" in path for path in read)
    after = {t: files_of(spark, t) for t in tables}
    for table in tables:
        changed = {b for b in before[table].keys() | after[table].keys() if before[table].get(b) != after[table].get(b)}
        assert changed <= (set(touched["claims"]) if table.endswith(".claims") else set())
    equal_to_whole(spark, names, layers, layers.as_of)

    # A provider becomes known: claims that name it leave quarantine, wherever they lie.
    put("providers", 1, missing)
    touched = incremental.refresh_changes(spark, names, BUCKETS, layers.as_of)
    assert len(touched["providers"]) == 1 and touched["claims"]
    equal_to_whole(spark, names, layers, layers.as_of)


def test_a_refresh_that_died_is_repeated(spark, land, monkeypatch):
    names, layers, put = land
    for dataset in incremental.ORDER:
        put(dataset, 0)
    done = incremental._judge

    def dying(spark_, namespace, name, numbers, now):
        if name == "claims":
            raise RuntimeError("lost")
        done(spark_, namespace, name, numbers, now)

    monkeypatch.setattr(incremental, "_judge", dying)
    with pytest.raises(RuntimeError):
        incremental.refresh_changes(spark, names, BUCKETS, layers.as_of)
    monkeypatch.setattr(incremental, "_judge", done)
    assert all(incremental.pending(spark, names).values())
    incremental.refresh_changes(spark, names, BUCKETS, layers.as_of)
    equal_to_whole(spark, names, layers, layers.as_of)


def shuffled_columns(df):
    """Numbers of columns that the shuffles of a plan carry."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    nodes = [plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            out.append(node.output().size())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_claims_are_kept_and_judged_without_shuffling_their_rows(spark, monkeypatch):
    names = Namespace(prefix="unshuffled_")
    names.create(spark, ("bronze", "silver", "quarantine"))
    shape = "claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount string, " \
        "date string, claim_status string, denial_reason_code string, allowed_amount string, paid_amount string, is_denied string, " \
        "follow_up_required string, _ingested_at int, _source_file string, _pipeline_run_id string, _row_id string"

    def claim(key, number, provider="p1", patient="P"):
        return (key, patient, provider, "d1", "x", "1.5", "2024-01-02", "OK", "NONE", "1", "1", "no", "no", number, "f", "r", f"row{number}")

    landed = [
        [claim(" c1 ", 1), claim("c2", 2), claim(None, 3), claim(" ", 4), claim("c3", 5, "p2"), claim("c4", 6)],
        [claim("C1", 7), claim("c2", 0), claim("c3", 8, "p2", None), claim("c5", 9), claim("c5", 9)],
    ]
    audit = "_ingested_at int, _source_file string, _pipeline_run_id string, _row_id string"
    providers = [("p1", "Dr A", "Skin", "X", 1, "f", "r", "p1"), ("P2", "Dr B", "Skin", "X", 1, "f", "r", "p2")]
    widest, done = {}, incremental.replace_partitions

    def watching(frame, table, *args, **kwargs):
        widest[table] = max([widest.get(table, 0), *shuffled_columns(frame)])
        return done(frame, table, *args, **kwargs)

    monkeypatch.setattr(incremental, "replace_partitions", watching)
    now = F.to_timestamp(F.lit("2024-06-01"))
    try:
        for batch, rows in enumerate(landed):
            tables = {
                "claims": spark.createDataFrame(rows, shape),
                "providers": spark.createDataFrame(providers[batch:batch + 1], f"provider_id string, doctor_name string, specialty string, location string, {audit}"),
                "diagnosis": spark.createDataFrame([("D1", "heart", "low", 1, "f", "r", "d1")] * (batch == 0), f"diagnosis_code string, category string, severity string, {audit}"),
            }
            for dataset, frame in tables.items():
                done(frame.withColumn(BATCH, F.lit(batch)), names.bronze(dataset), (BATCH,))
            incremental.refresh_changes(spark, names, BUCKETS, now)
        held = {t(d): widest[t(d)] for d in ("claims",) for t in (lambda d: incremental.keyed(names, d), names.silver, names.quarantine)}
        assert max(held.values()) <= 2, held
        trusted = sorted((r["claim_id"], r["_ingested_at"]) for r in spark.read.table(names.silver("claims")).collect())
        assert trusted == [("C1", 7), ("C2", 2), ("C4", 6), ("C5", 9), ("C5", 9)]
        failed = Counter((r["claim_id"], r["rule_name"]) for r in spark.read.table(names.quarantine("claims")).collect())
        assert failed == {(None, "missing_claim_id"): 2, ("C1", "duplicate_claim_id"): 1, ("C2", "duplicate_claim_id"): 1,
                          ("C3", "duplicate_claim_id"): 1, ("C3", "missing_patient_id"): 1}
    finally:
        for layer in ("bronze", "silver", "quarantine"):
            spark.sql(f"DROP DATABASE {names.database(layer)} CASCADE")


def test_files_of_kept_claims_hold_rows_enough():
    assert incremental.writing_tasks(0, 8, 8) == 1
    assert incremental.writing_tasks(800_000, 8, 8) == 3
    for rows, held, cores in ((72_000_000, 128, 12), (720_000_000, 128, 12)):
        tasks = incremental.writing_tasks(rows, held, cores)
        assert tasks >= cores and rows / (tasks * held) >= incremental.ROWS_PER_FILE


def test_contests_of_kept_claims_are_found_once(spark):
    from claimloom.operators.newest import DEALT, deal_out, mark_newest_bucketed


    rows = spark.range(200).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.col("id").alias("_ingested_at"),
        F.lit("r").alias("_pipeline_run_id"), F.lit("f").alias("_source_file"), F.concat(F.lit("row"), "id").alias("_row_id"))
    deal_out(rows, ["k"]).write.bucketBy(3, "k", DEALT).saveAsTable("kept_once")
    try:
        kept = spark.read.table("kept_once")
        assert incremental.parts_of(spark, "kept_once") == 3
        plain, stored = mark_newest_bucketed(kept, ["k"]), mark_newest_bucketed(kept, ["k"], buckets=3)
        assert stored.exceptAll(plain).isEmpty() and stored.count() == 200
        found = stored._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in found and "Exchange" not in found
    finally:
        spark.sql("DROP TABLE kept_once")
