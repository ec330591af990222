"""Operational tables from a run's event log, whether its details are structs or JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.diagnostics import failure_id_of
from claimloom.functions.events import ACTION_TEXT, typed

# The event types and levels that are read.
LIFECYCLE = ("create_update", "update_progress", "flow_progress")
USER_EVENTS = ("user_action", "create_update")
FAILURE_LEVELS = ("ERROR", "WARN")


def event_log(spark, table: str | None = None, frame: DataFrame | None = None) -> DataFrame:
    """The event log, from exactly one of a published table or a frame."""
    if (table is None) == (frame is None):
        raise ValueError("give exactly one of table or frame")
    return spark.table(table) if frame is None else frame


def _of(events: DataFrame, *kinds: str) -> DataFrame:
    return typed(events.where(F.col("event_type").isin(*kinds)))


def _update_id():
    return F.coalesce("origin.update_id", "details.update_id").alias("update_id")


def _pipeline_id():
    return F.coalesce("origin.pipeline_id", "details.pipeline_id").alias("pipeline_id")


def updates(events: DataFrame) -> DataFrame:
    state = F.coalesce("details.update_progress.state", "details.flow_progress.status", "details.state", "message")
    actor = F.coalesce("origin.user_name", "user_identity")
    return _of(events, *LIFECYCLE).select(
        "timestamp", "event_type", _update_id(), _pipeline_id(), state.alias("update_state"), actor.alias("actor")
    )


def expectation_metrics(events: DataFrame) -> DataFrame:
    """One row per expectation of every flow event; events without expectations give none."""
    found = F.explode("details.flow_progress.data_quality.expectations").alias("_e")
    rows = _of(events, "flow_progress").select("timestamp", _update_id(), found).where(F.col("_e").isNotNull())
    return rows.select(
        "timestamp", "update_id", "_e.dataset", F.col("_e.name").alias("expectation"), "_e.passed_records", "_e.failed_records"
    )


def user_actions(events: DataFrame) -> DataFrame:
    actor = F.coalesce("origin.user_name", "user_identity", "details.user_action.user_name")
    action = F.coalesce("details.user_action.action", ACTION_TEXT, "message")
    return _of(events, *USER_EVENTS).select(
        "timestamp", _update_id(), actor.alias("actor"), "event_type", action.alias("action_name"), _pipeline_id()
    )


def failures(events: DataFrame, latest_only: bool = False) -> DataFrame:
    """Failure rows with a stable diagnostic; all of them, or the newest of each dataset."""
    dataset = F.coalesce("details.dataset", "details.flow_name", "details.flow_progress.metrics.dataset")
    rows = typed(events.where(F.col("level").isin(*FAILURE_LEVELS))).select(
        "timestamp",
        dataset.alias("dataset"),
        _update_id(),
        F.coalesce("error.error_code", "details.error_code").alias("platform_error_code"),
        F.coalesce("error.message", "message").alias("error_message"),
    )
    if latest_only:
        newest = F.max(F.struct("timestamp", "update_id", "platform_error_code", "error_message")).alias("_last")
        rows = rows.groupBy("dataset").agg(newest).select("_last.timestamp", "dataset", *(
            f"_last.{c}" for c in ("update_id", "platform_error_code", "error_message")
        ))
    return rows.withColumn("diagnostic_id", failure_id_of(F.col("dataset")))


TABLES = {
    "ops_pipeline_updates": updates,
    "ops_expectation_metrics": expectation_metrics,
    "ops_user_actions": user_actions,
    "ops_latest_failures": failures,
}
