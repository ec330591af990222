"""Runs that write whole layers: Silver, Gold, the summaries, and the operational tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.functions.diagnostics import table_ready
from claimloom.model import ALL_DATASETS, GOLD_PHI, POLICIES
from claimloom.namespace import Namespace, properties, set_properties
from claimloom.plans import analytics, eventlog, gold, quality, silver
from claimloom.sinks import overwrite, publish_all, scratch, stage
from claimloom.sources.snapshots import bronze_snapshot

SILVER_DATASETS = ("providers", "diagnosis", "cost", "claims", "policy_chunks")


def read_bronze(spark: SparkSession, namespace: Namespace) -> dict[str, DataFrame]:
    return {name: bronze_snapshot(spark, namespace.bronze(name)) for name in ALL_DATASETS}


def refresh_silver(spark: SparkSession, bronze: Mapping[str, DataFrame], namespace: Namespace) -> None:
    """Validate every dataset once into a stage, then write its trusted and quarantine tables from it."""
    with scratch(spark):
        _write_silver(spark, bronze, namespace)


def _write_silver(spark: SparkSession, bronze: Mapping[str, DataFrame], namespace: Namespace) -> None:
    now = F.lit(spark.sql("SELECT current_timestamp() AS t").first()["t"])
    validated = {
        "claims": silver.validated_claims(bronze["claims"], bronze["providers"], bronze["diagnosis"], now),
        "providers": silver.validated_providers(bronze["providers"], now),
        "diagnosis": silver.validated_diagnosis(bronze["diagnosis"], now),
        "cost": silver.validated_cost(bronze["cost"], now),
        "policy_chunks": silver.validated_documents(bronze["policies"], now),
    }
    namespace.create(spark, ("silver", "quarantine"))
    for name in SILVER_DATASETS:
        rows = stage(validated[name], f"validated_{name}")
        dataset = ALL_DATASETS.get(name, POLICIES)
        if name == "policy_chunks":
            kept, held = silver.policy_chunks(rows), silver.quarantined_documents(rows, now)
            held_cluster = ("path", "diagnostic_id")
        else:
            kept, held = silver.trusted_rows(rows), silver.quarantined_rows(rows, name, now)
            held_cluster = (dataset.keys[0], "diagnostic_id")
        layout = {namespace.silver(name): (kept, dataset.cluster), namespace.quarantine(name): (held, held_cluster)}
        for table, (frame, cluster) in layout.items():
            overwrite(frame, table, cluster)
            comment = table_ready("Silver", table, "silver_pipeline", dataset.sensitivity)
            set_properties(spark, table, properties(dataset.sensitivity, dataset.phi, "silver"), comment)


def silver_tables(spark: SparkSession, namespace: Namespace) -> dict[str, DataFrame]:
    return {name: spark.read.table(namespace.silver(name)) for name in SILVER_DATASETS}


def quarantine_tables(spark: SparkSession, namespace: Namespace) -> dict[str, DataFrame]:
    return {name: spark.read.table(namespace.quarantine(name)) for name in SILVER_DATASETS}


def refresh_gold(spark: SparkSession, namespace: Namespace) -> str:
    tables = silver_tables(spark, namespace)
    features = gold.gold_features(*(tables[n] for n in ("claims", "providers", "diagnosis", "cost")))
    namespace.create(spark, ("gold",))
    # Cutting ranges samples the frame first; stored, it is computed once.
    with scratch(spark):
        table = overwrite(stage(features, "gold_features"), namespace.gold("claim_features"), ("claim_id",))
    comment = table_ready("Gold", table, "gold_pipeline", "SENSITIVE")
    set_properties(spark, table, properties("SENSITIVE", GOLD_PHI, "gold"), comment)
    return table


def claim_summaries(
    bronze: Mapping[str, DataFrame], trusted: Mapping[str, DataFrame], quarantined_claims: DataFrame
) -> dict[str, DataFrame]:
    """The fifteen summary tables by name."""
    claims, providers = trusted["claims"], trusted["providers"]
    diagnosis, cost = trusted["diagnosis"], trusted["cost"]
    with_providers = analytics.claims_with_providers(claims, providers)
    with_diagnosis = analytics.claims_with_diagnosis(claims, diagnosis)
    enriched = analytics.cost_enriched(claims, providers, cost)
    return {
        "claims_provider_joined": with_providers,
        "claims_diagnosis_joined": with_diagnosis,
        "claims_by_specialty_summary": analytics.by_specialty(with_providers),
        "claims_by_region_summary": analytics.by_region(with_providers),
        "claims_by_diagnosis_summary": analytics.by_diagnosis(with_diagnosis),
        "claims_provider_specialty_mismatch": analytics.specialty_mismatch(claims, providers, diagnosis),
        "high_cost_claims_summary": analytics.high_cost_claims(enriched),
        "claims_dashboard_summary": analytics.dashboard_by_date(enriched),
        "claims_adjudication_summary": analytics.adjudication_summary(claims),
        "claims_denial_reason_summary": analytics.denial_reasons(claims),
        "claims_revenue_daily_summary": analytics.revenue_by_date(claims),
        "bronze_pipeline_audit": analytics.ingest_audit(dict(bronze)),
        "ops_data_freshness": analytics.freshness(dict(bronze)),
        "silver_claims_cost_enriched": enriched,
        "silver_claim_lineage": analytics.claim_lineage(claims, quarantined_claims),
    }


def refresh_summaries(spark: SparkSession, bronze: Mapping[str, DataFrame], namespace: Namespace, workers: int = 4) -> dict[str, str]:
    """Write the summaries. They read stored Silver tables, so nothing needs to be cached."""
    namespace.create(spark, ("analytics",))
    frames = claim_summaries(
        bronze, silver_tables(spark, namespace), spark.read.table(namespace.quarantine("claims"))
    )
    written = publish_all({namespace.analytics(n): df for n, df in frames.items()}, workers)
    return {
        name: table_ready("Analytics", written[namespace.analytics(name)], "analytics_build", "MINIMUM-NECESSARY")
        for name in frames
    }


def refresh_quality(spark: SparkSession, namespace: Namespace) -> dict[str, str]:
    namespace.create(spark, ("analytics",))
    kept, held = silver_tables(spark, namespace), quarantine_tables(spark, namespace)
    return publish_all({
        namespace.analytics("ops_silver_table_status"): quality.table_status(kept, held, namespace),
        namespace.analytics("ops_quarantine_summary"): quality.quarantine_summary(held),
    })


def refresh_event_tables(spark: SparkSession, events: DataFrame, namespace: Namespace, workers: int = 4) -> dict[str, str]:
    """Write the four event-log tables. Each reads only its own columns and event types of the stored log."""
    namespace.create(spark, ("analytics",))
    return publish_all({namespace.analytics(n): build(events) for n, build in eventlog.TABLES.items()}, workers)
