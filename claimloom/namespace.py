"""Table names, databases and table properties of the layers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

LAYERS = ("bronze", "silver", "quarantine", "gold", "analytics")

# Properties recorded on every table.
RETENTION = "interval 2190 days"
COMMON_PROPERTIES = {
    "delta.enableChangeDataFeed": "true",
    "delta.logRetentionDuration": RETENTION,
    "delta.deletedFileRetentionDuration": RETENTION,
}


@dataclass(frozen=True)
class Namespace:
    """Where tables live: ``[catalog.]{prefix}{layer}.{table}``."""

    catalog: str | None = None
    prefix: str = ""

    def database(self, layer: str) -> str:
        name = f"{self.prefix}{layer}"
        return f"{self.catalog}.{name}" if self.catalog else name

    def table(self, layer: str, name: str) -> str:
        return f"{self.database(layer)}.{name}"

    def bronze(self, name: str) -> str:
        return self.table("bronze", name)

    def silver(self, name: str) -> str:
        return self.table("silver", name)

    def quarantine(self, name: str) -> str:
        return self.table("quarantine", name)

    def gold(self, name: str) -> str:
        return self.table("gold", name)

    def analytics(self, name: str) -> str:
        return self.table("analytics", name)

    def create(self, spark: SparkSession, layers: Iterable[str] = LAYERS) -> None:
        for layer in layers:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database(layer)}")


def properties(sensitivity: str, phi: Iterable[str] = (), layer: str | None = None) -> dict[str, str]:
    extra = {"claimloom.layer": layer} if layer else {}
    return {
        **COMMON_PROPERTIES,
        **extra,
        "hipaa.phi_columns": ",".join(sorted(phi)),
        "hipaa.data_sensitivity": sensitivity,
    }


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def set_properties(spark: SparkSession, table: str, values: dict[str, str], comment: str | None = None) -> None:
    pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in values.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")
    if comment:
        spark.sql(f"COMMENT ON TABLE {table} IS {_quoted(comment)}")


def read_properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def missing_properties(spark: SparkSession, table: str, required: Iterable[str]) -> list[str]:
    present = read_properties(spark, table)
    return sorted(k for k in required if k not in present)


def missing_tables(spark: SparkSession, tables: Iterable[str]) -> list[str]:
    return [t for t in tables if not spark.catalog.tableExists(t)]
