"""Profiling and verification checks; each is one aggregate pass that stays a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.cleaning import trim_to_null
from claimloom.model import AUDIT, ROW_ID
from claimloom.operators.lookups import lookup
from claimloom.operators.quantiles import exact_quantiles

ANOMALY_RATIO = 10.0
OVERBILLING_RATIO = 2.0


def _share(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, 0.0 for an empty whole."""
    value = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return F.round(F.coalesce(value, F.lit(0.0)), 2)


def _missing(column: str) -> Column:
    return trim_to_null(column).isNull()


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int | None]) -> DataFrame:
    """Rows per table against the manifest."""
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("row_count")) for name, df in tables.items()
    ])
    pairs = [F.lit(x) for name in tables for x in (name, expected.get(name) if expected.get(name) is not None else -1)]
    wanted = F.create_map(*pairs)[F.col("dataset")].cast("long")
    return counts.withColumn("expected_rows", F.nullif(wanted, F.lit(-1).cast("long"))).withColumn(
        "matches", F.col("row_count").eqNullSafe(F.col("expected_rows"))
    )


def null_profile(df: DataFrame, name: str) -> DataFrame:
    """Null or blank values per data column."""
    columns = [c for c in df.columns if not c.startswith("_")]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count_if(_missing(c)).alias(c) for c in columns))
    return counts.unpivot("_rows", columns, "column", "null_count").select(
        F.lit(name).alias("table"), "column", "null_count", _share(F.col("null_count"), F.col("_rows")).alias("null_pct")
    )


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and surplus rows, from per-key counts; NULL is one key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys")
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_keys"))


def most_duplicated(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The report of the most repeated keys."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    return per_key.orderBy(F.desc("count"), F.asc(key)).limit(top)


def missing_rates(claims: DataFrame) -> DataFrame:
    """Missing procedure codes (null or blank) and missing amounts (null), in one pass."""
    return claims.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(_missing("procedure_code")).alias("missing_procedure"),
        F.count_if(F.col("billed_amount").isNull()).alias("missing_billed"),
    ).select(
        "*",
        _share(F.col("missing_procedure"), F.col("total_claims")).alias("missing_procedure_pct"),
        _share(F.col("missing_billed"), F.col("total_claims")).alias("missing_billed_pct"),
    )


def amount_summary(claims: DataFrame, amount: Column) -> DataFrame:
    """Extremes, mean, 95th percentile and an outlier mark for one exact decimal amount.

    The percentile is exact.
    """
    value = amount.cast("double")
    p95 = exact_quantiles(claims.select(value.alias("v")), "v", [0.95])[0]
    mean = F.sum(amount).cast("double") / F.nullif(F.count(amount), F.lit(0))
    return claims.agg(
        F.min(value).alias("min_billed"),
        F.max(value).alias("max_billed"),
        mean.alias("avg_billed"),
        F.lit(p95).cast("double").alias("p95_billed"),
        F.count(amount).alias("non_null_count"),
    ).withColumn(
        "is_anomaly",
        F.coalesce((F.col("avg_billed") > 0) & (F.col("max_billed") / F.col("avg_billed") > ANOMALY_RATIO), F.lit(False)),
    )


def orphan_keys(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows`` that ``reference`` does not have."""
    return rows.select(key).distinct().join(reference.select(key).distinct(), key, "left_anti")


def missing_locations(providers: DataFrame) -> DataFrame:
    return providers.agg(
        F.count(F.lit(1)).alias("providers"), F.count_if(_missing("location")).alias("missing_location")
    ).withColumn("missing_location_pct", _share(F.col("missing_location"), F.col("providers")))


def missing_location_rows(providers: DataFrame, top: int = 10) -> DataFrame:
    """The first providers without a location, by id, for a look at them."""
    return providers.where(_missing("location")).orderBy("provider_id", *(c for c in (ROW_ID,) if c in providers.columns)).limit(top)


def overbilled(claims: DataFrame, cost: DataFrame, billed: Column, expected: Column) -> DataFrame:
    """Claims against every benchmark of their procedure, whatever the region, above the ratio.

    The benchmarks of a procedure, one per region, become one array, so a claim meets one row, is compared
    inside the array and comes out only for its hits.
    """
    priced = cost.withColumn("_expected", expected).where(F.col("_expected") > 0)
    entry = F.struct("region", "expected_cost", "_expected")
    prices = priced.groupBy("procedure_code").agg(F.collect_list(entry).alias("_prices"))
    rows = lookup(claims.where(F.col("procedure_code").isNotNull()).withColumn("_billed", billed), prices, on=["procedure_code"])

    def ratio(price: Column) -> Column:
        return F.col("_billed").cast("double") / price["_expected"].cast("double")

    hits = F.filter("_prices", lambda p: ratio(p) > OVERBILLING_RATIO)
    found = rows.where(F.size(hits) > 0).select("claim_id", "procedure_code", "billed_amount", "_billed", F.explode(hits).alias("_p"))
    return found.select(
        "claim_id", "procedure_code", "billed_amount", "_p.expected_cost", "_p.region", ratio(F.col("_p")).alias("overbilling_ratio")
    )


def top_overbilled(over: DataFrame, top: int = 10) -> DataFrame:
    order = [F.desc("overbilling_ratio"), *(F.asc(c) for c in ("claim_id", "region", "billed_amount", "expected_cost"))]
    return over.orderBy(*order).limit(top)


def audit_completeness(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows with an empty audit column per table, over all rows."""
    return reduce(DataFrame.unionByName, [
        df.agg(
            F.lit(name).alias("dataset"),
            F.count(F.lit(1)).alias("row_count"),
            *(F.count_if(F.col(c).isNull()).alias(f"null{c}") for c in AUDIT),
        )
        for name, df in tables.items()
    ])


def reconcile_counts(table_rows: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Table rows against source rows per dataset: MATCH, MISMATCH or SOURCE_MISSING."""
    joined = table_rows.join(source_rows, "dataset", "left")
    status = (
        F.when(F.col("source_rows").isNull(), "SOURCE_MISSING")
        .when(F.col("table_rows") == F.col("source_rows"), "MATCH")
        .otherwise("MISMATCH")
    )
    return joined.withColumn("status", status)


def landing_status(landed: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Landed rows against the manifest: matched, mismatch, or pending-upload where nothing landed."""
    spark = landed.sparkSession
    manifest = spark.createDataFrame(list(expected.items()), "dataset string, expected_rows long")
    status = (
        F.when(F.col("landed_rows").isNull(), "pending-upload")
        .when(F.col("landed_rows") == F.col("expected_rows"), "matched")
        .otherwise("mismatch")
    )
    return manifest.join(landed, "dataset", "left").withColumn("status", status)


def non_empty(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("dataset"), (F.count(F.lit(1)) > 0).alias("non_empty")) for name, df in tables.items()
    ])


def frequency(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(column))


def headline(claims: DataFrame, amount: Column) -> DataFrame:
    return claims.agg(
        F.count(F.lit(1)).alias("total_claims"),
        (F.sum(amount).cast("double") / F.nullif(F.count(amount), F.lit(0))).alias("avg_billed_amount"),
        F.count_if(F.col("procedure_code").isNull()).alias("missing_procedure_code_rows"),
        F.count_if(F.col("billed_amount").isNull()).alias("missing_billed_amount_rows"),
    )


def safe_preview(claims: DataFrame) -> DataFrame:
    """Claims without direct identifiers: the patient only as a digest."""
    return claims.select(
        F.sha2(F.col("patient_id"), 256).alias("patient_id_hash"),
        "provider_id", "procedure_code", "claim_status", "denial_reason_code",
    )


def summary(claims: DataFrame, providers: DataFrame, amount: Column, skip: Iterable[str] = ()) -> DataFrame:
    """The six profiling questions with their verdicts; skipped ones read NOT RUN."""
    skip = set(skip)
    unique = key_uniqueness(claims, "claim_id").select(
        F.when(F.col("duplicate_rows") == 0, "PASS").otherwise(
            F.concat(F.lit("FAIL: "), F.col("duplicate_rows"), F.lit(" duplicate rows"))).alias("result"))
    missing = missing_rates(claims)
    orphans = orphan_keys(claims, providers, "provider_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") == 0, "PASS").otherwise(F.concat(F.lit("FAIL: "), F.col("n"), F.lit(" orphans"))).alias("result"))
    rows: Sequence[tuple[str, str, DataFrame]] = (
        ("Q1", "claim_id unique?", unique),
        ("Q2", "missing procedure_code %", missing.select(F.format_string("%.2f%%", "missing_procedure_pct").alias("result"))),
        ("Q3", "missing billed_amount %", missing.select(F.format_string("%.2f%%", "missing_billed_pct").alias("result"))),
        ("Q4", "provider_id ref integrity", orphans),
        ("Q5", "max billed_amount", claims.agg(F.max(amount).cast("string").alias("result"))),
        ("Q6", "providers missing location", missing_locations(providers).select(
            F.col("missing_location").cast("string").alias("result"))),
    )
    spark = claims.sparkSession
    return reduce(DataFrame.unionByName, [
        (spark.range(1).select(F.lit("NOT RUN").alias("result")) if number in skip else result).select(
            F.lit(number).alias("question"), F.lit(check).alias("check"), "result"
        )
        for number, check, result in rows
    ])
