from claimloom import session


def test_only_lopsided_inputs_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SMALL_INPUT", 0)
    tasks = spark.sparkContext.defaultParallelism
    rows = spark.range(4000)
    rows.repartition(4 * tasks).write.option("compression", "none").parquet(str(tmp_path / "even"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        even, one = (spark.read.parquet(str(tmp_path / n)) for n in ("even", "one"))
        assert session.spread(even) is even
        assert session.spread(one) is not one and session.spread(one).count() == 4000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
