import pytest

from claimloom.plans import eventlog

STRUCTS = ("timestamp string, event_type string, level string, message string, user_identity string, "
           "origin struct<update_id:string,user_name:string>, details struct<pipeline_id:string,state:string,dataset:string,flow_name:string,"
           "user_action:struct<action:string,user_name:string>,flow_progress:struct<status:string,data_quality:struct<expectations:"
           "array<struct<name:string,dataset:string,passed_records:bigint,failed_records:bigint>>>>>, error struct<error_code:string,message:string>")


@pytest.fixture()
def structs(spark):
    return spark.createDataFrame([
        ("1", "create_update", "INFO", "m1", "id1", ("u1", None), ("p1", "S", None, None, None, None), None),
        ("2", "flow_progress", "WARN", "m2", None, (None, "bob"), ("p1", None, "claims", "f", None, ("RUN", ([("e1", "claims", 5, 1), ("e2", "cost", 2, 0)],))), None),
        ("3", "user_action", "INFO", "m3", None, None, ("p1", None, None, None, ("start", "eve"), None), None),
        ("4", "flow_progress", "ERROR", "m4", None, None, (None, None, None, "cost", None, ("FAIL", ([],))), ("E1", "broke")),
        ("5", "other", "ERROR", "m5", None, None, None, None),
    ], STRUCTS)


@pytest.fixture()
def texts(structs):
    return structs.selectExpr("timestamp", "event_type", "level", "message", "user_identity",
                              "to_json(origin) origin", "to_json(details) details", "to_json(error) error")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("build", list(eventlog.TABLES.values()))
def test_both_shapes_agree(structs, texts, build):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, build(structs).collect()), key=key) == sorted(map(tuple, build(texts).collect()), key=key)


def test_values(structs):
    updates = {r["timestamp"]: r for r in eventlog.updates(structs).collect()}
    assert (updates["1"]["update_id"], updates["1"]["update_state"], updates["1"]["actor"]) == ("u1", "S", "id1")
    assert (updates["2"]["update_state"], updates["2"]["actor"], updates["4"]["update_state"]) == ("RUN", "bob", "FAIL")
    assert rows(eventlog.expectation_metrics(structs)) == [("2", None, "claims", "e1", 5, 1), ("2", None, "cost", "e2", 2, 0)]
    actions = {r["timestamp"]: (r["actor"], r["action_name"]) for r in eventlog.user_actions(structs).collect()}
    assert actions == {"1": ("id1", "m1"), "3": ("eve", "start")}
    failures = {r["timestamp"]: (r["dataset"], r["error_message"], r["diagnostic_id"]) for r in eventlog.failures(structs).collect()}
    assert failures == {"2": ("claims", "m2", "CLM-OBS-401"), "4": ("cost", "broke", "CLM-OBS-404"), "5": (None, "m5", "CLM-OBS-499")}


def test_user_action_as_plain_text(spark):
    df = spark.createDataFrame([("1", "user_action", ("stop",))], "timestamp string, event_type string, details struct<user_action:string>")
    assert eventlog.user_actions(df).first()["action_name"] == "stop"


def test_missing_columns_become_null(spark):
    df = spark.createDataFrame([("1", "flow_progress", "ERROR")], "timestamp string, event_type string, level string")
    for build in eventlog.TABLES.values():
        build(df).collect()
    assert eventlog.updates(df).first()["update_state"] is None


def test_latest_only(structs):
    again = structs.unionByName(structs.where("timestamp = '2'").selectExpr("'9' timestamp", "* except (timestamp)"))
    latest = {r["dataset"]: r["timestamp"] for r in eventlog.failures(again, latest_only=True).collect()}
    assert latest == {"claims": "9", "cost": "4", None: "5"}


def test_exactly_one_source(spark, structs):
    with pytest.raises(ValueError):
        eventlog.event_log(spark)
    with pytest.raises(ValueError):
        eventlog.event_log(spark, table="t", frame=structs)


def test_bracketed_messages_survive_in_both_shapes(structs, texts):
    from pyspark.sql import functions as F

    marked = F.struct(F.lit("E9").alias("error_code"), F.lit("[TABLE_OR_VIEW_NOT_FOUND] {no} such table").alias("message"))
    for log, column in ((structs, marked), (texts, F.to_json(marked))):
        found = eventlog.failures(log.withColumn("error", column)).select("error_message").distinct().collect()
        assert [r[0] for r in found] == ["[TABLE_OR_VIEW_NOT_FOUND] {no} such table"]


def test_text_actions_in_json(spark):
    df = spark.createDataFrame([("1", "user_action", '{"user_action":"{stop"}'), ("2", "user_action", '{"user_action":{"action":"go"}}')], "timestamp string, event_type string, details string")
    assert {r["timestamp"]: r["action_name"] for r in eventlog.user_actions(df).collect()} == {"1": "{stop", "2": "go"}
