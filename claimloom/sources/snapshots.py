"""Batch reads of stored tables and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.model import FEATURES, ROW_ID, TARGET, Dataset


def snapshot(spark: SparkSession, table: str) -> DataFrame:
    """The whole table as it is now; never a stream, since ranking needs all rows."""
    return spark.read.table(table)


def bronze_snapshot(spark: SparkSession, table: str) -> DataFrame:
    """A stored Bronze table whose rows carry ``_row_id``: the file and row they lie in.

    The id costs nothing to keep and, unlike a generated one, is the same in every evaluation.
    """
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return spark.read.table(table).select("*", place.alias(ROW_ID))


def gold_features(spark: SparkSession, table: str) -> DataFrame:
    """The model's inputs and target; stays distributed."""
    return spark.read.table(table).select("claim_id", *FEATURES, TARGET)


def landed_csv(spark: SparkSession, path: str, dataset: Dataset | None = None) -> DataFrame:
    """Landed CSV files of one layout as a batch, all columns text, the declared ones by name."""
    rows = spark.read.option("header", True).csv(path)
    if dataset is None:
        return rows
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in dataset.columns))


def rows_as_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
