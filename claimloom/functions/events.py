"""One typed form of the event log, whatever shape its details have landed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The paths of the log that are read, as schemas of its nested columns.
PLAIN = ("timestamp", "event_type", "level", "message", "user_identity")
NESTED = {
    "origin": "update_id string, pipeline_id string, user_name string",
    "details": (
        "update_id string, pipeline_id string, state string, dataset string, flow_name string, error_code string, "
        "user_action struct<action:string,user_name:string>, update_progress struct<state:string>, "
        "flow_progress struct<status:string,metrics:struct<dataset:string>,data_quality:struct<expectations:"
        "array<struct<name:string,dataset:string,passed_records:bigint,failed_records:bigint>>>>"
    ),
    "error": "error_code string, message string",
}
ACTION_TEXT = "user_action_text"


def _fitted(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """``value`` in the declared type; fields it lacks, and values of another shape, are NULL."""
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            return F.lit(None).cast(want)
        kinds = {f.name: f.dataType for f in have.fields}
        fields = [
            (_fitted(value[f.name], kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType):
        if not isinstance(have, T.ArrayType):
            return F.lit(None).cast(want)
        return F.transform(value, lambda x: _fitted(x, have.elementType, want.elementType))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(None).cast(want)
    return value.cast(want)


def typed(events: DataFrame) -> DataFrame:
    """The log with the declared columns only: JSON text is parsed once into the declared schema.

    Columns the log does not have are NULL. An action that is plain text and not an object is kept in
    ``user_action_text``.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    out = [F.col(c).cast(kinds[c] if c == "timestamp" else "string").alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in PLAIN]
    text = F.lit(None).cast("string")
    for root, ddl in NESTED.items():
        want = T.StructType.fromDDL(ddl)
        if root not in kinds:
            column = F.lit(None).cast(want)
        elif isinstance(kinds[root], T.StringType):
            column = F.from_json(root, want)
            if root == "details":
                text = F.when(column["user_action"].isNull(), F.from_json(root, "user_action string")["user_action"])
        else:
            column = _fitted(F.col(root), kinds[root], want)
            action = kinds[root]["user_action"].dataType if root == "details" and "user_action" in kinds[root].names else None
            if isinstance(action, T.StringType):
                text = F.col("details.user_action")
        out.append(column.alias(root))
    return events.select(*out, text.alias(ACTION_TEXT))
