import pytest
from pyspark.sql import functions as F

from claimloom.operators.lookups import lookup
from claimloom.operators.newest import DEALT, PRIORITY, deal_out, keep_newest, mark_newest, mark_newest_bucketed, mark_newest_grouped, number_copies, upsert

COLUMNS = "k string, v string, _ingested_at int, _pipeline_run_id string, _source_file string"
ROWS = [
    ("a", "old", 1, "r", "f"), ("a", "new", 2, "r", "f"), ("b", "only", 1, "r", "f"),
    (None, "n1", 1, "r", "f"), (None, "n2", 2, "r", "f"), ("c", "run1", 1, "r1", "f"), ("c", "run2", 1, "r2", "f"),
    ("d", "same", 1, "r", "f"), ("d", "same", 1, "r", "f"), ("d", "same", 1, "r", "f"),
    ("e", "undated", None, "z", "z"), ("e", "dated", 1, "r", "f"),
]


def priorities(df):
    return sorted((str(r["k"]), r["v"], r[PRIORITY]) for r in df.collect())


EXPECTED = sorted([
    ("a", "old", 2), ("a", "new", 1), ("b", "only", 1), ("None", "n1", 1), ("None", "n2", 1),
    ("c", "run1", 2), ("c", "run2", 1), ("d", "same", 1), ("d", "same", 2), ("d", "same", 2),
    ("e", "undated", 2), ("e", "dated", 1),
])


def test_newest_row_wins_and_copies_keep_one(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    assert priorities(mark_newest(df, ["k"])) == EXPECTED


def test_same_answer_without_broadcasts(spark, small_broadcasts_off):
    df = spark.createDataFrame(ROWS, COLUMNS).repartition(4)
    assert priorities(mark_newest(df, ["k"])) == EXPECTED


def test_row_id_decides_ties(spark):
    df = spark.createDataFrame(ROWS, COLUMNS).withColumn("_row_id", F.monotonically_increasing_id())
    rows = mark_newest(df.cache(), ["k"]).where("k = 'd'").collect()
    assert sorted(r[PRIORITY] for r in rows) == [1, 2, 2]
    assert max(rows, key=lambda r: r["_row_id"])[PRIORITY] == 1


@pytest.mark.parametrize("copies", [1, 9_999, 10_000, 10_001, 25_000])
def test_copies_are_numbered_without_loss(spark, copies):
    df = spark.range(copies).select(F.lit("x").alias("v"))
    out = number_copies(df, "id").agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(out) == (copies, copies, 1, copies)


def test_one_key_with_most_rows(spark, small_broadcasts_off):
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit("v").alias("v"),
        F.col("id").alias("_ingested_at"), F.lit("r").alias("_pipeline_run_id"), F.lit("f").alias("_source_file"), F.col("id").alias("_row_id"))
    counts = {r[0]: r[1] for r in mark_newest(hot, ["k"]).groupBy(PRIORITY).count().collect()}
    assert counts == {1: 20_001, 2: 9_999}


def test_upsert_keeps_latest(spark):
    current = spark.createDataFrame([("a", "1", 1, "r", "f"), ("b", "1", 5, "r", "f")], COLUMNS)
    changes = spark.createDataFrame([("a", "2", 2, "r", "f"), ("b", "2", 4, "r", "f"), ("c", "2", 1, "r", "f")], COLUMNS)
    assert sorted((r["k"], r["v"]) for r in upsert(current, changes, ["k"]).collect()) == [("a", "2"), ("b", "1"), ("c", "2")]
    assert keep_newest(current, ["k"]).count() == 2


def test_lookup_null_keys_and_null_safe(spark, small_broadcasts_off):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "b", 1)], "id int, k string, d int")
    table = spark.createDataFrame([("a", None, "A"), (None, 1, "N"), ("b", 1, "B")], "k string, d int, x string")
    strict = {r["id"]: r["x"] for r in lookup(rows, table, on=["k", "d"]).collect()}
    assert strict == {1: None, 2: None, 3: "B"}
    safe = {r["id"]: r["x"] for r in lookup(rows, table, on=["k", "d"], null_safe=["d"]).collect()}
    assert safe == {1: "A", 2: None, 3: "B"}


@pytest.mark.parametrize("hot_rows", [1, 2, 1_000])
def test_rows_grouped_by_key_are_marked_alike(spark, hot_rows):
    df = spark.createDataFrame(ROWS, COLUMNS).repartition(3)
    assert priorities(mark_newest_grouped(df, ["k"], hot_rows=hot_rows)) == EXPECTED
    numbered = spark.createDataFrame([(*r, i // 2) for i, r in enumerate(ROWS)], COLUMNS + ", _row_id int")
    assert priorities(mark_newest_grouped(numbered, ["k"], hot_rows=hot_rows)) == priorities(mark_newest(numbered, ["k"]))


def test_grouped_rows_cross_one_shuffle_and_a_hot_key_is_dealt_out(spark, small_broadcasts_off):
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.lit("v").alias("v"),
        F.col("id").alias("_ingested_at"), F.lit("r").alias("_pipeline_run_id"), F.lit("f").alias("_source_file"), F.col("id").alias("_row_id"))
    marked = mark_newest_grouped(hot, ["k"])
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert "Join" not in marked._jdf.queryExecution().optimizedPlan().toString()
    spread = mark_newest_grouped(hot, ["k"], hot_rows=5_000)
    assert {r[0]: r[1] for r in spread.groupBy(PRIORITY).count().collect()} == {1: 20_001, 2: 9_999}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()) < 12_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot_rows", [1, 2, 1_000])
def test_bucketed_rows_are_marked_alike_without_a_shuffle(spark, small_broadcasts_off, hot_rows):
    df = spark.createDataFrame([(*r, i // 2) for i, r in enumerate(ROWS)] + [("f", "v", 1, "r", "f", None)] * 2, COLUMNS + ", _row_id int")
    spark.sql("DROP TABLE IF EXISTS kept_by_key")
    deal_out(df, ["k"], hot_rows=hot_rows).write.bucketBy(8, "k", DEALT).saveAsTable("kept_by_key")
    try:
        kept = spark.read.table("kept_by_key")
        dealt = {r["k"] for r in kept.where(F.col(DEALT) != 0).collect()}
        assert dealt == {None} | {k for k, n in {"a": 2, "c": 2, "d": 3, "e": 2, "f": 2}.items() if n > hot_rows}
        marked = mark_newest_bucketed(kept, ["k"])
        assert priorities(marked) == priorities(mark_newest(df, ["k"]))
        assert marked.columns == [*df.columns, PRIORITY]
        if dealt == {None}:
            assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE kept_by_key")


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_slotted_rows_have_the_same_newest(spark, hot_rows):
    from claimloom.operators.newest import SLOT, key_slot
    from claimloom.sinks import stage_bucketed

    rows = spark.range(600).select(
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("k"), F.least(F.col("id") % 90, F.lit(70)))).alias("k"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 5 AS int))").alias("_ingested_at"),
        F.when(F.col("id") % 13 > 0, F.lit("r")).alias("_pipeline_run_id"), F.lit("f").alias("_source_file"),
        F.concat(F.lit("row"), "id").alias("_row_id"))
    wanted = mark_newest(rows, ("k",))
    kept = stage_bucketed(rows.withColumn(SLOT, key_slot([F.col("k")])), "slotted", 4, (SLOT,))
    got = mark_newest_grouped(kept, ("k",), hot_rows=hot_rows)
    assert got.columns == wanted.columns
    assert got.exceptAll(wanted).isEmpty() and got.count() == 600
