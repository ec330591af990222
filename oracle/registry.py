"""Every registered query: its Spark form and, where SQL can say it, the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import model as M
from claimloom.functions import cleaning as C
from claimloom.functions import privacy
from claimloom.functions import text as TX
from claimloom.functions.events import typed
from claimloom.namespace import Namespace
from claimloom.operators import drift, expectations, flags, profiling, retrieval, rules
from claimloom.operators.activity import provider_days
from claimloom.operators.newest import PRIORITY, SLOT, mark_newest, upsert
from claimloom.plans import analytics, eventlog, gold, incremental, labels, modelling, quality, refresh, silver
from claimloom.sinks import clustered, publish, replace_partitions, shared_folder, stage, stage_all
from claimloom.sources.snapshots import landed_csv
from claimloom.sources.testbed import MODEL_COLUMNS, Layers
from claimloom.streaming import ingest
from oracle.layers_sql import AS_OF_SQL, boolean, money, title, with_layers

NAMES = Namespace(prefix="claims_")


@dataclass(frozen=True)
class Query:
    build: Callable[[Layers], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}
SELECTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Layers], DataFrame]):
        QUERIES[name] = Query(build, with_layers(sql) if sql else None)
        SELECTS[name] = sql or ""
        return build

    return add


def portable(df: DataFrame) -> DataFrame:
    """The same values in types that every engine and driver shows alike."""
    def convert(field: T.StructField):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, T.BooleanType):
            column = column.cast("int")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        return column.alias(field.name)

    return df.select(*(convert(f) for f in df.schema.fields))


def dbl(*cs: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cs)


def num(*cs: str) -> str:
    return ", ".join(f"CAST({c} AS INT) AS {c}" for c in cs)


def txt(*cs: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cs)


def ts(*cs: str) -> str:
    return ", ".join(f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in cs)


# --- Sources -------------------------------------------------------------------------------

RAW = {n: ", ".join(d.columns) for n, d in M.CSV_DATASETS.items()}


@query("src4_bronze_snapshot", f"SELECT {RAW['claims']}, _source_file, _pipeline_run_id, {ts('_ingested_at')} FROM bronze_claims")
def _(L):
    return L.raw("claims").select(*M.CLAIMS.columns, "_source_file", "_pipeline_run_id", "_ingested_at")


@query("src5_sibling_view", "SELECT rule_name, count(*) AS n FROM v_claims GROUP BY rule_name")
def _(L):
    rows = L.validated("claims")
    return rows.groupBy(F.col("_failure.rule_name").alias("rule_name")).agg(F.count(F.lit(1)).alias("n"))


@query("src7_event_log", f"SELECT {ts('timestamp')}, event_type, level, message, user_identity, origin, details, error FROM bronze_event_log")
def _(L):
    return eventlog.event_log(L.spark, frame=L.event_log())


# An empty CSV field is NULL.
BLANK_IS_NULL = {n: ", ".join(f"nullif({c}, '') AS {c}" for c in d.columns) for n, d in M.CSV_DATASETS.items()}


def _land(L: Layers, name: str, layouts: bool = True) -> str:
    """Land a raw table as CSV files: as declared, with the columns turned round, and with one more column."""
    folder = f"{shared_folder(L.spark)}/landed/{name}-{uuid.uuid4().hex}"
    columns = list(M.CSV_DATASETS[name].columns)
    source = L.stored_raw(name) if layouts else L.raw(name)  # three writes read it
    rows = source.select(*columns).withColumn("note", F.concat(F.lit("n-"), F.coalesce(F.col(columns[-1]), F.lit(""))))
    kind = F.pmod(F.length(F.coalesce(F.col(columns[1]), F.lit(""))), F.lit(3)) if layouts else F.lit(0)
    for n, wanted in enumerate((columns, columns[::-1], [*columns, "note"])):
        if n == 0 or layouts:
            options = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}
            rows.where(kind == n).select(*wanted).write.options(**options).csv(f"{folder}/{n}")
    return folder


def _ingested(L: Layers, name: str) -> DataFrame:
    """The landed table after two runs of the stream, of which the second must add nothing."""
    folder = _land(L, name)
    target = f"{folder}-bronze"
    for _ in range(2):
        ingest.ingest_csv(L.spark, folder, M.CSV_DATASETS[name], target, f"{folder}-marks").awaitTermination()
    return ingest.landed_rows(L.spark, target)


@query("src1_csv_stream", f"SELECT {BLANK_IS_NULL['claims']}, CAST(NULL AS VARCHAR) AS _rescued_data FROM bronze_claims")
def _(L):
    return _ingested(L, "claims").select(*M.CLAIMS.columns, M.RESCUED)


@query("src2_evolving_columns", """SELECT procedure_code, average_cost, expected_cost, region,
  CASE WHEN length(coalesce(average_cost, '')) % 3 = 2 THEN concat('n-', coalesce(region, '')) END AS note FROM bronze_cost""")
def _(L):
    return _ingested(L, "cost").select(*M.COST.columns, "note")


def _land_forms(L: Layers, name: str, short: bool = False) -> DataFrame:
    """Land a raw table as CSV files in four forms and read what the stream makes of them.

    The last column of every row holds a line break. By row, files have plain headers, blank lines before the
    header, a header that repeats a name in other case, or one that uses a name of lineage; the last two carry
    one value more. With ``short``, the rows of the second form lack their last value.
    """
    folder = f"{shared_folder(L.spark)}/landed/{name}-{uuid.uuid4().hex}"
    columns = list(M.CSV_DATASETS[name].columns)
    last = F.concat(F.substring(columns[-1], 1, 1), F.lit("\n"), F.expr(f"substring({columns[-1]}, 2)"))
    kind = F.pmod(F.ascii(F.substring(F.coalesce(F.col(columns[0]), F.lit("")), -1, 1)), F.lit(4))
    rows = L.raw(name).select(*columns[:-1], last.alias(columns[-1]), F.concat(F.lit("x-"), F.col(columns[0])).alias("extra"), kind.alias("kind"))
    as_is = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = lambda *names: F.to_csv(F.struct(*names), as_is)
    one = line(*columns[:-1]) if short else line(*columns)
    text = F.when(F.col("kind") == 0, line(*columns)).when(F.col("kind") == 1, one).otherwise(line(*columns, "extra"))
    header = ",".join(columns)
    heads = {0: header, 1: f"\n\n{header}", 2: f"{header},{columns[1].upper()}", 3: f"{header},_rescued_data"}
    head = F.element_at(F.create_map(*[F.lit(x) for item in heads.items() for x in item]), F.col("kind"))
    files = max(1, rows.count() // 2000)  # a file for about each 500 rows of a form
    one_file = rows.groupBy("kind", F.pmod(F.xxhash64(columns[0]), F.lit(files)).alias("part")).agg(F.array_join(F.collect_list(text), "\n").alias("value"))
    one_file.select("kind", "part", F.concat(head, F.lit("\n"), "value").alias("value")).write.partitionBy("kind", "part").text(folder)
    for _ in range(2):
        ingest.ingest_csv(L.spark, folder, M.CSV_DATASETS[name], f"{folder}-bronze", f"{folder}-marks", glob="*.txt").awaitTermination()
    return ingest.landed_rows(L.spark, f"{folder}-bronze")


def _forms_sql(name: str) -> str:
    *others, last = M.CSV_DATASETS[name].columns
    broken = f"nullif(substr({last}, 1, 1) || chr(10) || substr({last}, 2), '')"
    return f"SELECT {', '.join(f'nullif({c}, {chr(39) * 2}) AS {c}' for c in others)}, {broken} AS {last}, ascii(right(coalesce({others[0]}, ''), 1)) % 4 AS kind FROM bronze_{name}"


@query("src1_record_forms", f"""SELECT * EXCLUDE (kind), CASE WHEN kind = 2 THEN 'x-' || provider_id END AS repeated,
  CASE WHEN kind = 3 THEN 'x-' || provider_id END AS reserved, CAST(NULL AS VARCHAR) AS _rescued_data FROM ({_forms_sql('providers')})""")
def _(L):
    columns = M.PROVIDERS.columns
    found = _land_forms(L, "providers")
    extra = {"repeated": f"{columns[1]}_{len(columns)}", "reserved": f"_rescued_data_{len(columns)}"}
    return found.select(*columns, *[F.col(c).alias(n) for n, c in extra.items()], M.RESCUED)


@query("aud4_marked_records", f"""SELECT * EXCLUDE (kind, severity), CASE WHEN kind <> 1 THEN severity END AS severity,
  CAST(kind = 1 AS INT) AS marked FROM ({_forms_sql('diagnosis')})""")
def _(L):
    return _land_forms(L, "diagnosis", short=True).select(*M.DIAGNOSIS.columns, F.col(M.RESCUED).isNotNull().cast("int").alias("marked"))


@query("src3_document_stream", "SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents")
def _(L):
    folder = f"{shared_folder(L.spark)}/landed/documents-{uuid.uuid4().hex}"
    L.source("documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(folder)
    for _ in range(2):
        ingest.append_files(ingest.document_stream(L.spark, folder), f"{folder}-bronze", f"{folder}-marks").awaitTermination()
    return L.spark.read.parquet(f"{folder}-bronze").agg(F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@query("src6_landed_csv", f"SELECT {BLANK_IS_NULL['providers']} FROM bronze_providers")
def _(L):
    return landed_csv(L.spark, f"{_land(L, 'providers', layouts=False)}/0", M.PROVIDERS)


@query("aud1_4_lineage", """SELECT count(*) AS landed, count(*) AS stamped, count(*) AS with_file, count(*) AS with_run, 0 AS malformed FROM bronze_diagnosis""")
def _(L):
    return _ingested(L, "diagnosis").agg(
        F.count(F.lit(1)).alias("landed"), F.count(M.INGESTED_AT).alias("stamped"), F.count_if(F.col(M.SOURCE_FILE).endswith(".csv")).alias("with_file"),
        F.count(M.RUN_ID).alias("with_run"), F.count(M.RESCUED).alias("malformed"))


@query("snk1_append_once", "SELECT count(*) AS first_run, count(*) AS second_run FROM bronze_providers")
def _(L):
    folder = _land(L, "providers")
    counts = []
    for _ in range(2):
        ingest.ingest_csv(L.spark, folder, M.PROVIDERS, f"{folder}-bronze", f"{folder}-marks").awaitTermination()
        counts.append(stage(ingest.landed_rows(L.spark, f"{folder}-bronze").agg(F.count(F.lit(1)).alias("n")), "runs"))
    first, second = (df.select(F.col("n").alias(c)) for df, c in zip(counts, ("first_run", "second_run")))
    return first.select("first_run", second.scalar().alias("second_run"))


FEATURE_LIST = ", ".join(M.FEATURES)


@query("src10_gold_for_model", f"""SELECT claim_id, denial_label, diagnosis_count, provider_claim_count, provider_claim_count_30d,
  diagnosis_severity_encoded, amount_to_benchmark_ratio, billed_vs_avg_cost, provider_risk_score,
  {num('is_procedure_missing', 'is_amount_missing', 'high_cost_flag', 'severity_procedure_mismatch', 'specialty_diagnosis_mismatch', 'provider_location_missing')} FROM gold""")
def _(L):
    return L.gold().select("claim_id", *M.FEATURES, M.TARGET)


@query("aud_lineage_columns", """SELECT _source_file, _pipeline_run_id, count(*) AS n, count(_ingested_at) AS stamped, count(_rescued_data) AS rescued
  FROM bronze_claims GROUP BY ALL""")
def _(L):
    return L.raw("claims").groupBy("_source_file", "_pipeline_run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("_ingested_at").alias("stamped"), F.count("_rescued_data").alias("rescued"))


# --- Expectations --------------------------------------------------------------------------

_T, _N = "upper(trim(is_denied)) IN ('1','TRUE','YES','Y')", "upper(trim(is_denied)) IN ('0','FALSE','NO','N')"
_EXPECT_SQL = {
    "claims": {
        "claim_id_not_null": "claim_id IS NOT NULL", "patient_id_not_null": "patient_id IS NOT NULL",
        "provider_id_not_null": "provider_id IS NOT NULL",
        "billed_amount_positive": "billed_amount IS NULL OR TRY_CAST(billed_amount AS DOUBLE) > 0",
        "no_parse_errors": "_rescued_data IS NULL",
        "claim_status_valid": "claim_status IS NULL OR upper(trim(claim_status)) IN ('APPROVED','DENIED')",
        "is_denied_matches_claim_status": f"claim_status IS NULL OR is_denied IS NULL OR (upper(trim(claim_status)) = 'DENIED' AND {_T}) OR (upper(trim(claim_status)) = 'APPROVED' AND {_N})",
        "non_negative_payment_amounts": "(allowed_amount IS NULL OR TRY_CAST(allowed_amount AS DOUBLE) >= 0) AND (paid_amount IS NULL OR TRY_CAST(paid_amount AS DOUBLE) >= 0)",
        "denial_reason_code_consistent": f"denial_reason_code IS NULL OR is_denied IS NULL OR ({_N} AND upper(trim(denial_reason_code)) = 'NONE') OR ({_T} AND upper(trim(denial_reason_code)) <> 'NONE')",
    },
    "providers": {"provider_id_not_null": "provider_id IS NOT NULL", "doctor_name_not_null": "doctor_name IS NOT NULL",
                  "location_present": "location IS NOT NULL", "no_parse_errors": "_rescued_data IS NULL"},
    "diagnosis": {"diagnosis_code_not_null": "diagnosis_code IS NOT NULL", "category_not_null": "category IS NOT NULL",
                  "severity_not_null": "severity IS NOT NULL", "no_parse_errors": "_rescued_data IS NULL"},
    "cost": {"procedure_code_not_null": "procedure_code IS NOT NULL",
             "average_cost_positive": "average_cost IS NULL OR TRY_CAST(average_cost AS DOUBLE) > 0",
             "expected_cost_positive": "expected_cost IS NULL OR TRY_CAST(expected_cost AS DOUBLE) > 0",
             "region_not_null": "region IS NOT NULL", "no_parse_errors": "_rescued_data IS NULL"},
    "policies": {"pdf_path_not_null": "path IS NOT NULL", "pdf_content_not_null": "content IS NOT NULL",
                 "pdf_size_positive": "length > 0"},
}
_EXPECT_KEYS = {"claims": "exp1_9", "providers": "exp10_13", "diagnosis": "exp14_17", "cost": "exp18_22", "policies": "exp23_25"}

for _name, _key in _EXPECT_KEYS.items():
    _sql = " UNION ALL ".join(
        f"SELECT '{_name}' AS dataset, '{e}' AS expectation, count(*) FILTER ({p}) AS passed_records, "
        f"count(*) - count(*) FILTER ({p}) AS failed_records FROM bronze_{_name}"
        for e, p in _EXPECT_SQL[_name].items()
    )
    query(f"{_key}_{_name}_expectations", _sql)(lambda L, n=_name: expectations.evaluate(L.raw(n), n))


# --- Cleaning ------------------------------------------------------------------------------


def _pairs(df: DataFrame, raw: str, value) -> DataFrame:
    return df.groupBy(F.col(raw).alias("raw"), value.alias("cleaned")).agg(F.count(F.lit(1)).alias("n"))


def _pairs_sql(table: str, raw: str, value: str, cast: str = "VARCHAR") -> str:
    return f"SELECT {raw} AS raw, CAST({value} AS {cast}) AS cleaned, count(*) AS n FROM {table} GROUP BY 1, 2"


@query("cln1_trim_to_null", _pairs_sql("bronze_claims", "claim_id", "nullif(trim(claim_id), '')"))
def _(L):
    return _pairs(L.raw("claims"), "claim_id", C.trim_to_null("claim_id"))


@query("cln2_normalize_code", _pairs_sql("bronze_claims", "provider_id", "upper(nullif(trim(provider_id), ''))"))
def _(L):
    return _pairs(L.raw("claims"), "provider_id", C.code("provider_id"))


@query("cln3_normalize_title", _pairs_sql("bronze_providers", "doctor_name", title("doctor_name")) + " UNION ALL " + _pairs_sql("bronze_providers", "specialty", title("specialty")))
def _(L):
    people = L.raw("providers")
    return _pairs(people, "doctor_name", C.title("doctor_name")).unionAll(_pairs(people, "specialty", C.title("specialty")))


@query("cln4_normalize_severity", _pairs_sql("bronze_diagnosis", "severity", title("severity")))
def _(L):
    return _pairs(L.raw("diagnosis"), "severity", C.severity("severity"))


@query("cln5_decimal_or_null", _pairs_sql("bronze_claims", "billed_amount", money("billed_amount"), "DOUBLE"))
def _(L):
    return _pairs(L.raw("claims"), "billed_amount", C.decimal_or_null("billed_amount"))


@query("cln6_date_or_null", _pairs_sql("bronze_claims", "date", "CAST(try_strptime(nullif(trim(date), ''), '%Y-%m-%d') AS DATE)"))
def _(L):
    return _pairs(L.raw("claims"), "date", C.date_or_null("date"))


@query("cln7_bool_or_null", _pairs_sql("bronze_claims", "is_denied", boolean("is_denied"), "INT"))
def _(L):
    return _pairs(L.raw("claims"), "is_denied", C.bool_or_null("is_denied"))


@query("cln8_quality_flags", "SELECT array_to_string(_data_quality_flags, '|') AS flags, count(*) AS n FROM ranked_claims GROUP BY 1")
def _(L):
    flagged = silver.clean_claims(L.raw("claims")).select(C.quality_flags({
        "missing_procedure_code": F.col("procedure_code").isNull(),
        "missing_billed_amount": F.col("billed_amount").isNull()}).alias("flags"))
    return flagged.groupBy("flags").agg(F.count(F.lit(1)).alias("n"))


@query("cln9_analytics_bool", _pairs_sql("bronze_claims", "follow_up_required", boolean("follow_up_required"), "INT"))
def _(L):
    return _pairs(L.raw("claims"), "follow_up_required", C.bool_or_null("follow_up_required"))


@query("cln10_amount_total", f"SELECT provider_id, CAST(sum({money('billed_amount')}) AS DOUBLE) AS total FROM bronze_claims GROUP BY 1")
def _(L):
    return L.raw("claims").groupBy("provider_id").agg(F.sum(C.amount(C.trim_to_null("billed_amount"))).cast("double").alias("total"))


@query("cln11_percent_or_null", """SELECT provider_id, round(count(billed_amount) / nullif(count(procedure_code), 0) * 100.0, 2) AS pct
  FROM bronze_claims GROUP BY 1""")
def _(L):
    return L.raw("claims").groupBy("provider_id").agg(C.percent(F.count("billed_amount"), F.count("procedure_code")).alias("pct"))


@query("cln12_imputed_location", "SELECT location, flags, count(*) AS n FROM v_providers GROUP BY 1, 2")
def _(L):
    return L.validated("providers").groupBy("location", F.array_join(M.QUALITY_FLAGS, "|").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


# --- Validation ----------------------------------------------------------------------------


@query("val1_reference_lookups", "SELECT 'provider' AS kind, k FROM known_providers UNION ALL SELECT 'diagnosis', k FROM known_diagnosis")
def _(L):
    known = {"provider": silver.known_keys(L.raw("providers"), "provider_id", "x"),
             "diagnosis": silver.known_keys(L.raw("diagnosis"), "diagnosis_code", "x")}
    frames = [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("k")) for kind, df in known.items()]
    return frames[0].unionByName(frames[1])


@query("val2_reference_marks", """SELECT provider_id, diagnosis_code, CAST(provider_known AS INT) AS provider_known,
  CAST(diagnosis_known AS INT) AS diagnosis_known, count(*) AS n FROM ranked_claims GROUP BY ALL""")
def _(L):
    claims = silver.clean_claims(L.raw("claims"))
    marked = silver.mark_references(claims, L.stored_raw("providers"), L.stored_raw("diagnosis"))
    return marked.groupBy("provider_id", "diagnosis_code",
                          F.col("_provider_known").isNotNull().alias("provider_known"),
                          F.col("_diagnosis_known").isNotNull().alias("diagnosis_known")).agg(F.count(F.lit(1)).alias("n"))


@query("val3_newest_wins_claims", "SELECT claim_id, _row_id, CASE WHEN rn = 1 OR claim_id IS NULL THEN 1 ELSE 2 END AS priority FROM ranked_claims")
def _(L):
    ranked = mark_newest(silver.clean_claims(L.raw("claims")), M.CLAIMS.keys, store_contest=True)
    return ranked.select("claim_id", "_row_id", F.col(PRIORITY).alias("priority"))


@query("val3_newest_wins_references", """
  SELECT 'providers' AS dataset, provider_id AS k, _source_file, CASE WHEN rn = 1 OR provider_id IS NULL THEN 1 ELSE 2 END AS priority FROM v_providers
  UNION ALL SELECT 'diagnosis', diagnosis_code, _source_file, CASE WHEN rn = 1 OR diagnosis_code IS NULL THEN 1 ELSE 2 END FROM v_diagnosis
  UNION ALL SELECT 'cost', procedure_code, _source_file, CASE WHEN rn = 1 OR procedure_code IS NULL OR region IS NULL THEN 1 ELSE 2 END FROM v_cost""")
def _(L):
    frames = [L.validated(d).select(F.lit(d).alias("dataset"), F.col(k).alias("k"), "_source_file", F.col(PRIORITY).alias("priority"))
              for d, k in (("providers", "provider_id"), ("diagnosis", "diagnosis_code"), ("cost", "procedure_code"))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("val4_claim_rules", "SELECT claim_id, _row_id, diagnostic_id, rule_name, quarantine_reason FROM v_claims")
def _(L):
    return L.validated("claims").select("claim_id", "_row_id", "_failure.*")


@query("val5_denial_consistency", """SELECT is_denied::INT AS is_denied, denial_reason_code,
  CAST(is_denied IS NULL OR denial_reason_code IS NULL OR (is_denied AND denial_reason_code = 'NONE') OR (NOT is_denied AND denial_reason_code <> 'NONE') AS INT) AS inconsistent,
  count(*) AS n FROM clean_claims GROUP BY ALL""")
def _(L):
    broken = next(r.broken for r in silver.CLAIM_RULES if r.name == "inconsistent_denial_label")
    return silver.clean_claims(L.raw("claims")).groupBy(
        "is_denied", "denial_reason_code", F.coalesce(F.expr(broken), F.lit(False)).alias("inconsistent")).agg(F.count(F.lit(1)).alias("n"))


for _i, _name, _keys in ((6, "providers", ("provider_id",)), (7, "diagnosis", ("diagnosis_code",)), (8, "cost", ("procedure_code", "region"))):
    query(f"val{_i}_{_name}_rules", f"SELECT {', '.join(_keys)}, _row_id, diagnostic_id, rule_name, quarantine_reason FROM v_{_name}")(
        lambda L, n=_name, k=_keys: L.validated(n).select(*k, "_row_id", "_failure.*"))

_AUDIT_SQL = f"_source_file, _pipeline_run_id, {ts('_ingested_at')}"
_CLAIM_TEXT = "claim_id, patient_id, provider_id, diagnosis_code, procedure_code, claim_status, denial_reason_code"
_SILVER_SQL = {
    "claims": f"{_CLAIM_TEXT}, {dbl('billed_amount', 'allowed_amount', 'paid_amount')}, {txt('date')}, {num('is_denied', 'follow_up_required')}, array_to_string(_data_quality_flags, '|') AS _data_quality_flags",
    "providers": "provider_id, doctor_name, specialty, location, flags AS _data_quality_flags",
    "diagnosis": "diagnosis_code, category, severity, '' AS _data_quality_flags",
    "cost": f"procedure_code, {dbl('average_cost', 'expected_cost')}, region, '' AS _data_quality_flags",
}
_STAMP = f"strftime({AS_OF_SQL}, '%Y-%m-%d %H:%M:%S.%f')"
_LINE = "concat('Quarantine summary recorded: dataset={d} rule_name=', rule_name, ' diagnostic_id=', diagnostic_id, ' quarantined_records=1') AS status_message"

for _name, _cols in _SILVER_SQL.items():
    _common = f"{_cols}, _rescued_data, {_AUDIT_SQL}, {_STAMP} AS _silver_processed_at"
    query(f"val9_trusted_{_name}", f"SELECT {_common} FROM t_{_name}")(lambda L, n=_name: L.trusted(n))
    query(f"val10_quarantine_{_name}",
          f"SELECT {_common}, diagnostic_id, rule_name, quarantine_reason, {_LINE.format(d=_name)}, {_STAMP} AS _quarantined_at FROM q_{_name}")(
        lambda L, n=_name: L.quarantined(n))


def _refreshed_by_batches(L: Layers, table: Callable[[Namespace, str], str], datasets: Sequence[str], columns: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Bronze landed in three batches, Silver refreshed after each, and tables of the last state, stored (all columns, or some)."""
    names = Namespace(prefix=f"changes_{uuid.uuid4().hex[:12]}_")
    names.create(L.spark, ("bronze", "silver", "quarantine"))
    for batch in range(3):
        for dataset in incremental.ORDER:
            # A batch of claims is told by columns of the line items alone: each lands straight from its own.
            rows = (L.raw if dataset == "claims" else L.stored_raw)(dataset).where(F.pmod(F.xxhash64(M.ROW_ID), F.lit(3)) == batch)
            replace_partitions(rows.withColumn(M.BATCH, F.lit(batch)), names.bronze(dataset), (M.BATCH,), incremental.CODEC)
        incremental.refresh_changes(L.spark, names, buckets=8, as_of=L.as_of)
    last = {d: incremental.refreshed(L.spark, table(names, d)) for d in datasets}
    found = {d: stage(f.select(*(c for c in f.columns if not columns or c in columns)), f"refreshed_{d}", codec=incremental.CODEC) for d, f in last.items()}
    for layer in ("bronze", "silver", "quarantine"):
        L.spark.sql(f"DROP DATABASE {names.database(layer)} CASCADE")
    return found


@query("snk2_incremental_claims", f"SELECT {_SILVER_SQL['claims']}, _rescued_data, {_AUDIT_SQL}, {_STAMP} AS _silver_processed_at FROM t_claims")
def _(L):
    return _refreshed_by_batches(L, lambda n, d: n.silver(d), ("claims",))["claims"].drop(M.ROW_ID)


@query("snk2_incremental_quarantine", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, {k} AS business_key, diagnostic_id, rule_name, quarantine_reason FROM q_{d}"
    for d, k in (("claims", "claim_id"), ("providers", "provider_id"), ("diagnosis", "diagnosis_code"), ("cost", "procedure_code"))))
def _(L):
    keys = {d: M.CSV_DATASETS[d].keys[0] for d in incremental.ORDER}
    found = _refreshed_by_batches(L, lambda n, d: n.quarantine(d), incremental.ORDER, (*keys.values(), *rules.FAILURE_FIELDS))
    parts = [f.select(F.lit(d).alias("dataset"), F.col(keys[d]).alias("business_key"), "diagnostic_id", "rule_name", "quarantine_reason") for d, f in found.items()]
    return reduce(DataFrame.unionByName, parts)


_DATASET_VIEWS = {"claims": "v_claims", "providers": "v_providers", "diagnosis": "v_diagnosis", "cost": "v_cost", "policy_chunks": "v_documents"}


@query("val11_reconciliation", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, count(*) AS input_rows, count(*) FILTER (rule_name IS NULL) AS trusted_rows, count(rule_name) AS quarantined_rows, 0 AS unaccounted_rows FROM {v}"
    for d, v in _DATASET_VIEWS.items()))
def _(L):
    frames = [rules.reconcile(L.validated(d), d) for d in _DATASET_VIEWS]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("val13_status_messages", f"SELECT DISTINCT {_LINE.format(d='claims')} FROM q_claims")
def _(L):
    return L.quarantined("claims").select("status_message").distinct()


# --- Documents -----------------------------------------------------------------------------


@query("txt1_text_extraction", "SELECT path, policy_text, extraction_status, extraction_error_message, length FROM v_documents")
def _(L):
    return L.validated("policy_chunks").select("path", "policy_text", "extraction_status", "extraction_error_message", "length")


@query("txt2_normalize_spaces", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM documents")
def _(L):
    return L.source("documents").select("doc_id", TX.normalize_spaces(F.col("text")).alias("text"))


@query("txt3_token_windows", "SELECT document_path, count(*) AS chunks, sum(token_count) AS tokens, max(token_count) AS longest, max(chunk_index) AS last_index FROM chunks GROUP BY 1")
def _(L):
    docs = silver.trusted_rows(L.validated("policy_chunks")).select(F.col("path").alias("document_path"), TX.chunks(F.col("policy_text")).alias("c"))
    return docs.select("document_path", F.size("c").alias("chunks"),
                       F.aggregate("c", F.lit(0), lambda s, x: s + x["token_count"]).alias("tokens"),
                       F.array_max(F.transform("c", lambda x: x["token_count"])).alias("longest"),
                       F.array_max(F.transform("c", lambda x: x["chunk_index"])).alias("last_index"))


@query("txt4_chunk_rows", "SELECT document_path, chunk_index, chunk_text, token_count FROM chunks")
def _(L):
    return L.trusted("policy_chunks").select("document_path", "chunk_index", "chunk_text", "token_count")


@query("txt5_chunk_ids", "SELECT chunk_id, document_path, chunk_index FROM chunks")
def _(L):
    return L.trusted("policy_chunks").select("chunk_id", "document_path", "chunk_index")


@query("txt6_embedding_status", "SELECT 'NOT_CONFIGURED' AS embedding_status, CAST(NULL AS VARCHAR) AS embedding_vector, count(*) AS n FROM chunks GROUP BY 1")
def _(L):
    return L.trusted("policy_chunks").groupBy("embedding_status", "embedding_vector").agg(F.count(F.lit(1)).alias("n"))


@query("txt7_document_flags", "SELECT path, flags AS _data_quality_flags FROM v_documents")
def _(L):
    return L.validated("policy_chunks").select("path", M.QUALITY_FLAGS)


@query("txt8_policy_chunks", f"""SELECT chunk_id, document_path, chunk_index, chunk_text, token_count, CAST(NULL AS VARCHAR) AS embedding_vector,
  'NOT_CONFIGURED' AS embedding_status, {_STAMP} AS _silver_processed_at, flags AS _data_quality_flags, _source_file, _pipeline_run_id FROM chunks""")
def _(L):
    return L.trusted("policy_chunks")


@query("txt9_document_quarantine", """SELECT path, extraction_status, flags AS _data_quality_flags, diagnostic_id, rule_name, quarantine_reason, _source_file,
  concat('Policy chunk extraction recorded: document_path=', path, ' chunk_count=0 diagnostic_id=', diagnostic_id) AS status_message
  FROM v_documents WHERE rule_name IS NOT NULL""")
def _(L):
    return L.quarantined("policy_chunks").select("path", "extraction_status", M.QUALITY_FLAGS, "diagnostic_id", "rule_name",
                                                 "quarantine_reason", "_source_file", "status_message")


# --- Gold ----------------------------------------------------------------------------------


@query("gld1_benchmark_join", f"SELECT claim_id, specialty, location, category, severity, {dbl('average_cost', 'expected_cost')} FROM gold")
def _(L):
    joined = gold.benchmark_join(L.trusted("claims"), *L.references())
    return joined.select("claim_id", "specialty", "location", "category", "severity", "average_cost", "expected_cost")


_CLAIM_FEATURES = {
    2: ("is_procedure_missing", "b"), 3: ("is_amount_missing", "b"), 4: ("amount_to_benchmark_ratio", "d"),
    5: ("billed_vs_avg_cost", "d"), 6: ("high_cost_flag", "b"), 7: ("severity_procedure_mismatch", "b"),
    8: ("specialty_diagnosis_mismatch", "b"), 9: ("provider_location_missing", "b"),
    10: ("diagnosis_severity_encoded", "b"), 14: ("denial_label", "b"),
}


def _claim_feature(L: Layers, name: str) -> DataFrame:
    joined = gold.benchmark_join(L.trusted("claims"), *L.references())
    return gold.claim_features(joined).select("claim_id", name)


for _i, (_name, _kind) in _CLAIM_FEATURES.items():
    query(f"gld{_i}_{_name}", f"SELECT claim_id, {num(_name) if _kind == 'b' else dbl(_name)} FROM gold")(
        lambda L, n=_name: _claim_feature(L, n))


@query("gld11_provider_risk", "SELECT provider_id, provider_claim_count, provider_risk_score FROM provider_totals")
def _(L):
    return provider_days(L.stored("claims"), M.TRAILING_DAYS).select("provider_id", "provider_claim_count", "provider_risk_score").distinct()


@query("gld12_provider_claims_30d", f"SELECT DISTINCT provider_id, {txt('date')}, provider_claim_count_30d FROM windowed_claims")
def _(L):
    return provider_days(L.stored("claims"), M.TRAILING_DAYS).select("provider_id", "date", "provider_claim_count_30d")


@query("gld13_diagnosis_count", "SELECT provider_id, diagnosis_count FROM provider_totals")
def _(L):
    return provider_days(L.stored("claims"), M.TRAILING_DAYS).select("provider_id", "diagnosis_count").distinct()


_GOLD_SQL = f"""SELECT claim_id, patient_id, provider_id, diagnosis_code, procedure_code, {txt('date')}, specialty, location, category, severity,
  {dbl('billed_amount', 'average_cost', 'expected_cost', 'amount_to_benchmark_ratio', 'billed_vs_avg_cost', 'provider_risk_score')},
  {num('is_denied', 'is_procedure_missing', 'is_amount_missing', 'high_cost_flag', 'severity_procedure_mismatch', 'specialty_diagnosis_mismatch', 'provider_location_missing')},
  diagnosis_severity_encoded, diagnosis_count, provider_claim_count, provider_claim_count_30d, denial_label,
  array_to_string(_data_quality_flags, '|') AS _data_quality_flags, {_AUDIT_SQL}, {_STAMP} AS _gold_processed_at, {_STAMP} AS _silver_processed_at FROM gold"""


@query("gld16_claim_features", _GOLD_SQL)
def _(L):
    return L.gold()


@query("gld15_no_outcome_columns", "SELECT count(*) AS rows_kept, 0 AS outcome_columns FROM gold")
def _(L):
    features = L.gold()
    leaked = set(gold.OUTCOME_COLUMNS) & set(features.columns)
    return features.agg(F.count(F.lit(1)).alias("rows_kept"), F.lit(len(leaked)).alias("outcome_columns"))


@query("gld13_diagnosis_count_approx", """SELECT count(*) AS providers, count(*) AS within_error FROM (
  SELECT provider_id FROM t_claims WHERE provider_id IS NOT NULL GROUP BY 1) x""")
def _(L):
    """How many providers the sketch counts within three times its stated relative error of 5 %."""
    claims = L.stored("claims")
    exact, rough = (
        provider_days(claims, M.TRAILING_DAYS, approx=a).select("provider_id", F.col("diagnosis_count").alias(n)).distinct()
        for a, n in ((False, "exact"), (True, "rough"))
    )
    near = F.abs(F.col("rough") - F.col("exact")) <= F.greatest(F.col("exact") * 0.15, F.lit(0.5))
    return exact.join(rough, "provider_id").agg(F.count(F.lit(1)).alias("providers"), F.count_if(near).alias("within_error"))


# --- Analytics -----------------------------------------------------------------------------

_JOIN_LINEAGE = "{a}._source_file AS {n}_source_file, {a}._pipeline_run_id AS {n}_pipeline_run_id, strftime({a}._ingested_at, '%Y-%m-%d %H:%M:%S.%f') AS {n}_ingested_at"
_JOIN_CLAIM = "c.claim_id, c.patient_id, c.provider_id, c.diagnosis_code, c.procedure_code, CAST(c.billed_amount AS DOUBLE) AS billed_amount, CAST(c.date AS VARCHAR) AS date, " + _JOIN_LINEAGE.format(a="c", n="claim")


@query("anl1_claims_provider_joined", f"""SELECT {_JOIN_CLAIM}, p.doctor_name, p.specialty, p.location, {_JOIN_LINEAGE.format(a='p', n='provider')}
  FROM t_claims c LEFT JOIN t_providers p ON c.provider_id = p.provider_id""")
def _(L):
    return analytics.claims_with_providers(L.trusted("claims"), L.stored("providers"))


@query("anl2_claims_diagnosis_joined", f"""SELECT {_JOIN_CLAIM}, d.category, d.severity, {_JOIN_LINEAGE.format(a='d', n='diagnosis')}
  FROM t_claims c LEFT JOIN t_diagnosis d ON c.diagnosis_code = d.diagnosis_code""")
def _(L):
    return analytics.claims_with_diagnosis(L.trusted("claims"), L.stored("diagnosis"))


def _billing_sql(groups: str, distinct: str, name: str, source: str) -> str:
    return f"""SELECT {groups}, count(*) AS claim_count, count(DISTINCT {distinct}) AS {name},
      CAST(sum(billed_amount) AS DOUBLE) / nullif(count(billed_amount), 0) AS avg_billed_amount, CAST(sum(billed_amount) AS DOUBLE) AS total_billed_amount
      FROM {source} GROUP BY ALL"""


@query("anl3_by_specialty", _billing_sql("specialty", "provider_id", "provider_count", "gold_joined"))
def _(L):
    return analytics.by_specialty(analytics.claims_with_providers(L.trusted("claims"), L.stored("providers")))


@query("anl4_by_region", _billing_sql("location AS region", "provider_id", "provider_count", "gold_joined"))
def _(L):
    return analytics.by_region(analytics.claims_with_providers(L.trusted("claims"), L.stored("providers")))


@query("anl5_by_diagnosis", _billing_sql("category, severity", "diagnosis_code", "diagnosis_code_count", "gold_joined"))
def _(L):
    return analytics.by_diagnosis(analytics.claims_with_diagnosis(L.trusted("claims"), L.stored("diagnosis")))


def _enriched(L: Layers) -> DataFrame:
    return analytics.cost_enriched(L.trusted("claims"), L.stored("providers"), L.stored("cost"))


@query("anl6_cost_enriched", f"""SELECT claim_id, provider_id, diagnosis_code, {txt('date')}, claim_procedure_code, doctor_name, specialty, provider_region,
  cost_procedure_code, cost_region, {dbl('billed_amount', 'expected_cost', 'amount_to_benchmark_ratio')} FROM enriched""")
def _(L):
    return _enriched(L)


@query("anl7_high_cost_claims", f"""SELECT claim_id, provider_id, doctor_name, specialty, provider_region AS region, claim_procedure_code AS procedure_code,
  {dbl('billed_amount', 'expected_cost', 'amount_to_benchmark_ratio')} FROM enriched WHERE expected_cost IS NOT NULL AND amount_to_benchmark_ratio >= 1.5""")
def _(L):
    return analytics.high_cost_claims(_enriched(L))


@query("anl8_dashboard_by_date", """SELECT CAST(date AS VARCHAR) AS claim_date, count(*) AS total_claims, count(DISTINCT provider_id) AS active_provider_count,
  CAST(sum(billed_amount) AS DOUBLE) AS total_billed_amount, CAST(sum(billed_amount) AS DOUBLE) / nullif(count(billed_amount), 0) AS avg_billed_amount,
  count(*) FILTER (amount_to_benchmark_ratio >= 1.5) AS high_cost_claim_count FROM enriched GROUP BY 1""")
def _(L):
    return analytics.dashboard_by_date(_enriched(L))


_ADJ = """count(*) AS total_claims, count(*) FILTER (NOT is_denied) AS approved_claims, count(*) FILTER (is_denied) AS denied_claims,
  count(*) FILTER (is_denied IS NULL) AS unknown_adjudication_status_claims, count(*) FILTER (follow_up_required) AS follow_up_required_claims,
  CAST(sum(billed_amount) AS DOUBLE) AS total_billed_amount, CAST(sum(allowed_amount) AS DOUBLE) AS total_allowed_amount,
  CAST(sum(paid_amount) AS DOUBLE) AS total_paid_amount"""


@query("anl9_adjudication", f"""SELECT *, round(denied_claims / nullif(total_claims, 0) * 100, 2) AS denial_rate_pct,
  round(total_allowed_amount / nullif(total_billed_amount, 0) * 100, 2) AS allowed_rate_pct,
  round(total_paid_amount / nullif(total_billed_amount, 0) * 100, 2) AS paid_rate_pct FROM (SELECT {_ADJ} FROM t_claims) x""")
def _(L):
    return analytics.adjudication_summary(L.trusted("claims"))


@query("anl10_denial_reasons", """SELECT coalesce(denial_reason_code, 'UNKNOWN') AS denial_reason_code, count(*) AS claim_count,
  count(*) FILTER (is_denied) AS denied_claims, CAST(sum(billed_amount) AS DOUBLE) AS total_billed_amount,
  CAST(sum(allowed_amount) AS DOUBLE) AS total_allowed_amount, CAST(sum(paid_amount) AS DOUBLE) AS total_paid_amount,
  CAST(sum(CASE WHEN is_denied THEN billed_amount ELSE 0 END) AS DOUBLE) AS denied_billed_amount,
  count(*) FILTER (follow_up_required) AS follow_up_required_claims FROM t_claims GROUP BY 1""")
def _(L):
    return analytics.denial_reasons(L.trusted("claims"))


@query("anl11_revenue_by_date", f"""SELECT *, round(denied_claims / nullif(total_claims, 0) * 100, 2) AS denial_rate_pct
  FROM (SELECT CAST(date AS VARCHAR) AS claim_date, {_ADJ} FROM t_claims GROUP BY 1) x""")
def _(L):
    return analytics.revenue_by_date(L.trusted("claims"))


@query("anl12_specialty_mismatch", f"""SELECT c.claim_id, c.provider_id, p.doctor_name, p.specialty, c.diagnosis_code, d.category, d.severity,
  CAST(lower(p.specialty) <> lower(d.category) AS INT) AS specialty_diagnosis_mismatch
  FROM t_claims c LEFT JOIN t_providers p ON c.provider_id = p.provider_id LEFT JOIN t_diagnosis d ON c.diagnosis_code = d.diagnosis_code""")
def _(L):
    return analytics.specialty_mismatch(L.trusted("claims"), L.stored("providers"), L.stored("diagnosis"))


_FIVE = ("claims", "providers", "diagnosis", "cost", "policies")


@query("anl13_ingest_audit", " UNION ALL ".join(
    f"""SELECT '{d}' AS dataset, _pipeline_run_id, count(*) AS row_count, count(DISTINCT _source_file) AS source_file_count,
    strftime(min(_ingested_at), '%Y-%m-%d %H:%M:%S.%f') AS first_ingested_at, strftime(max(_ingested_at), '%Y-%m-%d %H:%M:%S.%f') AS last_ingested_at
    FROM bronze_{d} GROUP BY _pipeline_run_id""" for d in _FIVE))
def _(L):
    return analytics.ingest_audit(L.bronze())


@query("anl14_data_freshness", " UNION ALL ".join(
    f"""SELECT '{d}' AS dataset, strftime(max(_ingested_at), '%Y-%m-%d %H:%M:%S.%f') AS latest_ingested_at, {_STAMP} AS observed_at,
    round(date_diff('second', max(_ingested_at), {AS_OF_SQL}) / 3600.0, 2) AS freshness_lag_hours FROM bronze_{d}""" for d in _FIVE))
def _(L):
    return analytics.freshness(L.bronze(), L.as_of)


@query("anl15_claim_lineage", f"""SELECT claim_id, strftime(_ingested_at, '%Y-%m-%d %H:%M:%S.%f') AS bronze_ingested_at, {_STAMP} AS silver_processed_at,
  CASE WHEN rule_name IS NULL THEN 'trusted' ELSE 'quarantined' END AS quarantine_status, diagnostic_id, rule_name FROM v_claims""")
def _(L):
    placed = L.validated("claims").select("claim_id", M.INGESTED_AT, M.PROCESSED_AT, rules.FAILURE)
    rows = stage(placed, "validated_claims", codec="zstd")
    return analytics.claim_lineage(silver.trusted_rows(rows), silver.quarantined_rows(rows, "claims", L.as_of))


_SUMMARIES = {
    "claims_provider_joined": "anl1_claims_provider_joined", "claims_diagnosis_joined": "anl2_claims_diagnosis_joined",
    "claims_by_specialty_summary": "anl3_by_specialty", "claims_by_region_summary": "anl4_by_region", "claims_by_diagnosis_summary": "anl5_by_diagnosis",
    "claims_provider_specialty_mismatch": "anl12_specialty_mismatch", "high_cost_claims_summary": "anl7_high_cost_claims",
    "claims_dashboard_summary": "anl8_dashboard_by_date", "claims_adjudication_summary": "anl9_adjudication",
    "claims_denial_reason_summary": "anl10_denial_reasons", "claims_revenue_daily_summary": "anl11_revenue_by_date",
    "bronze_pipeline_audit": "anl13_ingest_audit", "ops_data_freshness": "anl14_data_freshness", "silver_claims_cost_enriched": "anl6_cost_enriched",
    "silver_claim_lineage": "anl15_claim_lineage",
}


@query("anl16_all_summaries", " UNION ALL ".join(
    f"SELECT '{key}' AS table_key, count(*) AS row_count FROM ({SELECTS[name]}) t" for key, name in _SUMMARIES.items()))
def _(L):
    """Builds all fifteen summaries over one stored Silver layer and reports their sizes."""
    rows = stage(L.validated("claims").drop(*silver.HELPERS), "validated_claims", codec="zstd")
    trusted = {n: L.stored(n) for n in ("providers", "diagnosis", "cost")} | {"claims": silver.trusted_rows(rows)}
    bronze = L.bronze() | {"claims": L.slotted_claims().drop(SLOT)}  # two summaries of the landed rows read them
    frames = refresh.claim_summaries(bronze, trusted, silver.quarantined_rows(rows, "claims", L.as_of))
    sizes = [df.agg(F.lit(n).alias("table_key"), F.count(F.lit(1)).alias("row_count")) for n, df in frames.items()]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


# --- Quality and operations ----------------------------------------------------------------


def _status_sql(silver_rows: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS dataset, 'claims_silver.{d}' AS silver_table, {silver_rows if d == 'policy_chunks' else 'count(*) FILTER (rule_name IS NULL)'} AS silver_row_count,
        'claims_quarantine.{d}' AS quarantine_table, count(rule_name) AS quarantine_row_count,
        'Silver dataset ready: table=claims_silver.{d} category=silver_pipeline sensitivity={'PHI' if d == 'claims' else 'NON-PHI'}' AS status_message FROM {v}"""
        for d, v in _DATASET_VIEWS.items())


def _judged(L: Layers) -> dict[str, DataFrame]:
    """Validated rows of every dataset; those of documents with the number of their chunks."""
    validated = {d: L.validated(d) for d in _DATASET_VIEWS}
    documents = validated["policy_chunks"]
    validated["policy_chunks"] = documents.withColumn(
        "_chunks", F.when(F.col(rules.FAILURE).isNull(), TX.chunk_count(F.col("policy_text"))))
    return validated


def _status(L: Layers) -> DataFrame:
    return quality.table_status_of(_judged(L), NAMES, {"policy_chunks": "_chunks"})


@query("ops1_silver_table_status", _status_sql("(SELECT count(*) FROM chunks)"))
def _(L):
    return _status(L)


@query("ops2_quarantine_summary", " UNION ALL ".join(
    f"""SELECT '{d}' AS dataset, rule_name, diagnostic_id, count(*) AS quarantined_records,
    concat('Quarantine summary recorded: dataset={d} rule_name=', rule_name, ' diagnostic_id=', diagnostic_id, ' quarantined_records=', count(*)) AS status_message,
    'quarantine_audit' AS category FROM {v} WHERE rule_name IS NOT NULL GROUP BY rule_name, diagnostic_id""" for d, v in _DATASET_VIEWS.items()))
def _(L):
    return quality.quarantine_summary({d: L.quarantined(d) for d in _DATASET_VIEWS})


_UPDATE_ID = "coalesce(origin->>'$.update_id', details->>'$.update_id') AS update_id"
_EVENT_SQL = {
    "ops3_lifecycle_updates": f"""SELECT {ts('timestamp')}, event_type, {_UPDATE_ID}, origin->>'$.pipeline_id' AS pipeline_id,
      coalesce(details->>'$.update_progress.state', details->>'$.flow_progress.status', details->>'$.state', message) AS update_state,
      coalesce(origin->>'$.user_name', user_identity) AS actor FROM bronze_event_log WHERE event_type IN ('create_update','update_progress','flow_progress')""",
    "ops4_expectation_metrics": f"""SELECT timestamp, update_id, e->>'$.dataset' AS dataset, e->>'$.name' AS expectation,
      CAST(e->>'$.passed_records' AS BIGINT) AS passed_records, CAST(e->>'$.failed_records' AS BIGINT) AS failed_records FROM (
      SELECT {ts('timestamp')}, {_UPDATE_ID}, unnest(CAST(json_extract(details, '$.flow_progress.data_quality.expectations') AS JSON[])) AS e
      FROM bronze_event_log WHERE event_type = 'flow_progress') x""",
    "ops5_user_actions": f"""SELECT {ts('timestamp')}, event_type, {_UPDATE_ID},
      coalesce(origin->>'$.user_name', user_identity, details->>'$.user_action.user_name') AS actor,
      coalesce(details->>'$.user_action.action', message) AS action_name, origin->>'$.pipeline_id' AS pipeline_id
      FROM bronze_event_log WHERE event_type IN ('user_action','create_update')""",
    "ops6_failures": f"""SELECT *, CASE dataset WHEN 'claims' THEN 'CLM-OBS-401' WHEN 'providers' THEN 'CLM-OBS-402' WHEN 'diagnosis' THEN 'CLM-OBS-403'
      WHEN 'cost' THEN 'CLM-OBS-404' WHEN 'policies' THEN 'CLM-OBS-405' ELSE 'CLM-OBS-499' END AS diagnostic_id FROM (
      SELECT {ts('timestamp')}, coalesce(details->>'$.dataset', details->>'$.flow_progress.metrics.dataset') AS dataset, {_UPDATE_ID},
      coalesce(error->>'$.error_code', details->>'$.error_code') AS platform_error_code, coalesce(error->>'$.message', message) AS error_message
      FROM bronze_event_log WHERE level IN ('ERROR','WARN')) x""",
}
_EVENT_BUILD = {"ops3_lifecycle_updates": eventlog.updates, "ops4_expectation_metrics": eventlog.expectation_metrics,
                "ops5_user_actions": eventlog.user_actions, "ops6_failures": eventlog.failures}
for _key, _sql in _EVENT_SQL.items():
    query(f"{_key}_json", _sql)(lambda L, b=_EVENT_BUILD[_key]: b(L.event_log("json")))
    query(f"{_key}_struct", _sql)(lambda L, b=_EVENT_BUILD[_key]: b(L.event_log("struct")))


@query("ops6_failures_latest", f"""SELECT timestamp, dataset, update_id, platform_error_code, error_message, diagnostic_id FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY timestamp DESC, update_id DESC, platform_error_code DESC NULLS LAST, error_message DESC) AS rn
  FROM ({_EVENT_SQL['ops6_failures']}) f) r WHERE rn = 1""")
def _(L):
    return eventlog.failures(L.event_log("json"), latest_only=True)


@query("ops7_nested_paths", "SELECT origin->>'$.pipeline_id' AS pipeline_id, details->>'$.flow_progress.status' AS status, details->>'$.update_progress.state' AS state, count(*) AS n FROM bronze_event_log GROUP BY ALL")
def _(L):
    log = L.event_log("struct")
    return typed(log).groupBy("origin.pipeline_id", F.col("details.flow_progress.status").alias("status"),
                              F.col("details.update_progress.state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _sizes(frames: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n, df in frames.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


_RULES_HIT = " + ".join(f"(SELECT count(DISTINCT rule_name) FROM {v})" for v in _DATASET_VIEWS.values())


@query("ops8_quality_tables", f"SELECT 'ops_silver_table_status' AS table_name, 5 AS row_count UNION ALL SELECT 'ops_quarantine_summary', {_RULES_HIT}")
def _(L):
    judged = stage_all({d: f.select(rules.FAILURE, *(c for c in f.columns if c == "_chunks")) for d, f in _judged(L).items()})
    return _sizes(stage_all({
        "ops_silver_table_status": quality.table_status_of(judged, NAMES, {"policy_chunks": "_chunks"}),
        "ops_quarantine_summary": quality.quarantine_summary({d: silver.quarantined_rows(f, d, L.as_of) for d, f in judged.items()}),
    }))


@query("ops9_event_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM ({_EVENT_SQL[k]}) x" for t, k in (
        ("ops_pipeline_updates", "ops3_lifecycle_updates"), ("ops_expectation_metrics", "ops4_expectation_metrics"),
        ("ops_user_actions", "ops5_user_actions"), ("ops_latest_failures", "ops6_failures"))))
def _(L):
    log = L.event_log("json")
    return _sizes(stage_all({name: build(log) for name, build in eventlog.TABLES.items()}))


# --- Profiling -----------------------------------------------------------------------------

_EXPECTED = {n: d.expected_rows for n, d in M.ALL_DATASETS.items()}
_LANDED = ("providers", "diagnosis", "cost")


@query("ver4_reconciliation", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, count(*) AS table_rows, {'CAST(NULL AS BIGINT)' if d == 'cost' else 'count(*)'} AS source_rows, "
    f"'{'SOURCE_MISSING' if d == 'cost' else 'MATCH'}' AS status FROM bronze_{d}" for d in _LANDED))
def _(L):
    """Ingested tables against the rows that were landed; of one dataset no source count is known."""
    tables = {d: _ingested(L, d) for d in _LANDED}
    counted = lambda frames, n: reduce(DataFrame.unionByName, [df.agg(F.lit(d).alias("dataset"), F.count(F.lit(1)).alias(n)) for d, df in frames.items()])
    return profiling.reconcile_counts(counted(tables, "table_rows"), counted({d: L.raw(d) for d in _LANDED[:2]}, "source_rows"))


@query("ver5_landing_manifest", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, {_EXPECTED[d]} AS expected_rows, count(*) AS landed_rows, "
    f"CASE WHEN count(*) = {_EXPECTED[d]} THEN 'matched' ELSE 'mismatch' END AS status FROM bronze_{d}" for d in _LANDED)
    + f" UNION ALL SELECT 'claims', {_EXPECTED['claims']}, CAST(NULL AS BIGINT), 'pending-upload'")
def _(L):
    landed = [_ingested(L, d).agg(F.lit(d).alias("dataset"), F.count(F.lit(1)).alias("landed_rows")) for d in _LANDED]
    return profiling.landing_status(reduce(DataFrame.unionByName, landed), {d: _EXPECTED[d] for d in ("claims", *_LANDED)})


@query("prf1_row_counts", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, count(*) AS row_count, {_EXPECTED[d] if _EXPECTED[d] is not None else 'CAST(NULL AS BIGINT)'} AS expected_rows, "
    f"CAST({f'count(*) = {_EXPECTED[d]}' if _EXPECTED[d] is not None else 'false'} AS INT) AS matches FROM bronze_{d}" for d in _FIVE))
def _(L):
    return profiling.row_counts(L.bronze(), _EXPECTED)


def _null_sql(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{c}' AS "column", count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS null_count,
        round(count(*) FILTER ({c} IS NULL OR trim({c}) = '') * 100.0 / nullif(count(*), 0), 2) AS null_pct FROM bronze_{table}""" for c in columns)


@query("prf2_null_profile", " UNION ALL ".join(_null_sql(n, d.columns) for n, d in M.CSV_DATASETS.items()))
def _(L):
    frames = [profiling.null_profile(L.raw(n), n) for n in M.CSV_DATASETS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query("prf3_key_uniqueness", """SELECT count(*) AS total_rows, count(DISTINCT claim_id) + CAST(bool_or(claim_id IS NULL) AS INT) AS distinct_keys,
  count(*) - count(DISTINCT claim_id) - CAST(bool_or(claim_id IS NULL) AS INT) AS duplicate_rows FROM bronze_claims""")
def _(L):
    return profiling.key_uniqueness(L.raw("claims"), "claim_id")


@query("prf3_most_duplicated", "SELECT claim_id, count(*) AS count FROM bronze_claims GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(L):
    return profiling.most_duplicated(L.raw("claims"), "claim_id")


@query("prf4_missing_rates", """SELECT count(*) AS total_claims, count(*) FILTER (procedure_code IS NULL OR trim(procedure_code) = '') AS missing_procedure,
  count(*) FILTER (billed_amount IS NULL) AS missing_billed,
  round(count(*) FILTER (procedure_code IS NULL OR trim(procedure_code) = '') * 100.0 / count(*), 2) AS missing_procedure_pct,
  round(count(*) FILTER (billed_amount IS NULL) * 100.0 / count(*), 2) AS missing_billed_pct FROM bronze_claims""")
def _(L):
    return profiling.missing_rates(L.raw("claims"))


@query("prf5_amount_summary", f"""SELECT min_billed, max_billed, avg_billed, p95_billed, non_null_count, CAST(avg_billed > 0 AND max_billed / avg_billed > 10 AS INT) AS is_anomaly FROM (
  SELECT CAST(min(m) AS DOUBLE) AS min_billed, CAST(max(m) AS DOUBLE) AS max_billed, CAST(sum(m) AS DOUBLE) / count(m) AS avg_billed,
  CAST(quantile_disc(m, 0.95) AS DOUBLE) AS p95_billed, count(m) AS non_null_count FROM (SELECT {money('billed_amount')} AS m FROM bronze_claims) x) y""")
def _(L):
    return profiling.amount_summary(L.raw("claims"), C.decimal_or_null("billed_amount"))


@query("prf6_orphan_providers", "SELECT DISTINCT provider_id FROM t_claims WHERE provider_id NOT IN (SELECT provider_id FROM t_providers)")
def _(L):
    return profiling.orphan_keys(L.trusted("claims"), L.stored("providers"), "provider_id")


@query("prf7_missing_locations", """SELECT count(*) AS providers, count(*) FILTER (location IS NULL OR trim(location) = '') AS missing_location,
  round(count(*) FILTER (location IS NULL OR trim(location) = '') * 100.0 / count(*), 2) AS missing_location_pct FROM bronze_providers""")
def _(L):
    return profiling.missing_locations(L.raw("providers"))


@query("prf7_missing_location_rows", """SELECT provider_id, doctor_name, specialty, location, _row_id FROM bronze_providers
  WHERE location IS NULL OR trim(location) = '' ORDER BY provider_id NULLS FIRST, _row_id LIMIT 10""")
def _(L):
    return profiling.missing_location_rows(L.raw("providers")).select("provider_id", "doctor_name", "specialty", "location", "_row_id")


@query("gld9_imputed_location_missing", "SELECT claim_id, CAST(coalesce(location = 'Unknown', true) AS INT) AS provider_location_missing FROM gold")
def _(L):
    joined = gold.benchmark_join(L.trusted("claims"), *L.references())
    return gold.claim_features(joined, imputed_is_missing=True).select("claim_id", "provider_location_missing")


_OVER_SQL = """SELECT claim_id, c.procedure_code, CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(expected_cost AS DOUBLE) AS expected_cost, region,
  CAST(billed_amount AS DOUBLE) / CAST(expected_cost AS DOUBLE) AS overbilling_ratio
  FROM t_claims c JOIN t_cost k ON c.procedure_code = k.procedure_code
  WHERE CAST(billed_amount AS DOUBLE) / CAST(expected_cost AS DOUBLE) > 2.0"""


def _over(L: Layers) -> DataFrame:
    return profiling.overbilled(L.trusted("claims"), L.stored("cost"), F.col("billed_amount"), F.col("expected_cost"))


@query("prf8_overbilled_count", f"SELECT procedure_code, count(*) AS n FROM ({_OVER_SQL}) o GROUP BY 1")
def _(L):
    return _over(L).groupBy("procedure_code").agg(F.count(F.lit(1)).alias("n"))


@query("prf8_overbilled_top", f"{_OVER_SQL} ORDER BY overbilling_ratio DESC, claim_id, region, billed_amount, expected_cost LIMIT 10")
def _(L):
    return profiling.top_overbilled(_over(L))


@query("prf9_summary", f"""
  SELECT 'Q1' AS question, 'claim_id unique?' AS "check", CASE WHEN count(*) = count(DISTINCT claim_id) THEN 'PASS' ELSE concat('FAIL: ', count(*) - count(DISTINCT claim_id), ' duplicate rows') END AS result FROM bronze_claims
  UNION ALL SELECT 'Q2', 'missing procedure_code %', printf('%.2f%%', round(count(*) FILTER (procedure_code IS NULL OR trim(procedure_code) = '') * 100.0 / count(*), 2)) FROM bronze_claims
  UNION ALL SELECT 'Q3', 'missing billed_amount %', printf('%.2f%%', round(count(*) FILTER (billed_amount IS NULL) * 100.0 / count(*), 2)) FROM bronze_claims
  UNION ALL SELECT 'Q4', 'provider_id ref integrity', CASE WHEN count(*) = 0 THEN 'PASS' ELSE concat('FAIL: ', count(*), ' orphans') END
    FROM (SELECT DISTINCT c.provider_id AS p FROM bronze_claims c WHERE NOT EXISTS (SELECT 1 FROM bronze_providers b WHERE b.provider_id = c.provider_id)) o
  UNION ALL SELECT 'Q5', 'max billed_amount', CAST(max({money('billed_amount')}) AS VARCHAR) FROM bronze_claims
  UNION ALL SELECT 'Q6', 'providers missing location', CAST(count(*) FILTER (location IS NULL OR trim(location) = '') AS VARCHAR) FROM bronze_providers""")
def _(L):
    return profiling.summary(L.raw("claims"), L.raw("providers"), C.decimal_or_null("billed_amount"))


@query("ver3_audit_columns", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, count(*) AS row_count, count(*) FILTER (_ingested_at IS NULL) AS null_ingested_at, count(*) FILTER (_source_file IS NULL) AS null_source_file, "
    f"count(*) FILTER (_pipeline_run_id IS NULL) AS null_pipeline_run_id FROM bronze_{d}" for d in _FIVE))
def _(L):
    return profiling.audit_completeness(L.bronze())


@query("ver6_silver_not_empty", " UNION ALL ".join(f"SELECT '{d}' AS dataset, CAST(count(*) > 0 AS INT) AS non_empty FROM t_{d}" for d in M.CSV_DATASETS))
def _(L):
    return profiling.non_empty({d: L.trusted(d) for d in M.CSV_DATASETS})


@query("expa_safe_preview", "SELECT sha256(patient_id) AS patient_id_hash, provider_id, procedure_code, claim_status, denial_reason_code FROM bronze_claims")
def _(L):
    return profiling.safe_preview(L.raw("claims"))


@query("expb_frequencies", """SELECT 'diagnosis_code' AS field, diagnosis_code AS value, count(*) AS count FROM bronze_claims GROUP BY 2
  UNION ALL SELECT 'provider_id', provider_id, count(*) FROM bronze_claims GROUP BY 2""")
def _(L):
    claims = L.raw("claims")
    frames = [profiling.frequency(claims, c).select(F.lit(c).alias("field"), F.col(c).alias("value"), "count") for c in ("diagnosis_code", "provider_id")]
    return frames[0].unionByName(frames[1])


@query("expc_headline", f"""SELECT count(*) AS total_claims, CAST(sum({money('billed_amount')}) AS DOUBLE) / count({money('billed_amount')}) AS avg_billed_amount,
  count(*) FILTER (procedure_code IS NULL) AS missing_procedure_code_rows, count(*) FILTER (billed_amount IS NULL) AS missing_billed_amount_rows FROM bronze_claims""")
def _(L):
    return profiling.headline(L.raw("claims"), C.decimal_or_null("billed_amount"))


_HASHED = sorted(M.CLAIMS.phi)
_OPEN = [c for c in M.CLAIMS.columns if c not in M.CLAIMS.phi]


@query("phi1_hashed_claims", f"SELECT {', '.join(f'sha256({c}) AS {c}' for c in _HASHED)}, {', '.join(_OPEN)} FROM bronze_claims")
def _(L):
    return privacy.protect(L.raw("claims").select(*M.CLAIMS.columns), privacy.phi_columns("claims"))


@query("phi1_phi_dropped", f"SELECT {', '.join(_OPEN)}, count(*) AS n FROM bronze_claims GROUP BY ALL")
def _(L):
    kept = privacy.protect(L.raw("claims").select(*M.CLAIMS.columns), privacy.phi_columns("claims"), privacy.DROP)
    return kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n"))


# --- Labels --------------------------------------------------------------------------------

_LABEL_SQL = """SELECT claim_id, reason AS denial_reason_code, claim_status, CAST(allowed AS VARCHAR) AS allowed_amount,
  CASE WHEN reason = 'NONE' THEN CAST(allowed AS VARCHAR) ELSE '0.00' END AS paid_amount, CASE WHEN reason = 'NONE' THEN '0' ELSE '1' END AS is_denied,
  CASE WHEN reason = 'NONE' THEN '0' ELSE '1' END AS follow_up_required FROM labelled"""


#: What the label rules read and write.
_LABELLED = ("claim_id", "provider_id", "procedure_code", "billed_amount", *labels.LABELS)


def _relabelled(L: Layers, claims: DataFrame | None = None) -> DataFrame:
    return labels.relabelled(L.trusted("claims") if claims is None else claims, L.stored("providers"), L.stored("cost"), L.raw("review_ids"))


@query("lbl1_classified_claims", "SELECT claim_id, reason AS denial_reason_code, CAST(allowed AS DOUBLE) AS allowed_amount FROM labelled")
def _(L):
    bare = L.trusted("claims").drop(*labels.LABELS)
    priced = labels.expected_costs(bare, L.stored("providers"), L.stored("cost"))
    return labels.classified(labels.in_review(priced, L.raw("review_ids"))).select("claim_id", "denial_reason_code", "allowed_amount")


@query("lbl2_regional_benchmark", f"SELECT claim_id, {dbl('expected_cost')} FROM label_inputs")
def _(L):
    return labels.expected_costs(L.trusted("claims"), L.stored("providers"), L.stored("cost")).select("claim_id", "expected_cost")


@query("lbl3_applied_labels", _LABEL_SQL)
def _(L):
    return _relabelled(L).select("claim_id", *labels.LABELS)


@query("lbl4_review_claims", f"SELECT claim_id, {num('in_review')} FROM label_inputs")
def _(L):
    return labels.in_review(L.trusted("claims"), L.raw("review_ids")).select("claim_id", "in_review")


@query("lbl5_label_drift", """SELECT x.reason_changed, count(*) AS n FROM (
  SELECT t.claim_id, CAST(t.denial_reason_code IS DISTINCT FROM l.reason AS INT) AS reason_changed,
    t.claim_status IS DISTINCT FROM l.claim_status OR t.denial_reason_code IS DISTINCT FROM l.reason OR CAST(t.allowed_amount AS VARCHAR) IS DISTINCT FROM CAST(l.allowed AS VARCHAR)
    OR CAST(t.paid_amount AS VARCHAR) IS DISTINCT FROM CAST(l.paid AS VARCHAR) OR t.is_denied IS DISTINCT FROM (l.reason <> 'NONE') OR t.follow_up_required IS DISTINCT FROM (l.reason <> 'NONE') AS changed
  FROM t_claims t JOIN labelled l ON t.claim_id = l.claim_id) x WHERE changed GROUP BY 1""")
def _(L):
    claims = L.stored_claims(_LABELLED)
    stored = claims.withColumns({
        "allowed_amount": F.col("allowed_amount").cast("string"), "paid_amount": F.col("paid_amount").cast("string"),
        "is_denied": F.col("is_denied").cast("int").cast("string"), "follow_up_required": F.col("follow_up_required").cast("int").cast("string")})
    drifted = labels.label_drift(stored, _relabelled(L, claims))
    changed = F.array_contains("changed_columns", "denial_reason_code").alias("reason_changed")
    return drifted.groupBy(changed).agg(F.count(F.lit(1)).alias("n"))


# --- Model ---------------------------------------------------------------------------------


@query("ml2_filled_features", f"SELECT claim_id, {FEATURE_LIST} FROM features")
def _(L):
    return modelling.fill_features(L.gold(columns=MODEL_COLUMNS)).select("claim_id", *M.FEATURES)


@query("ml3_training_frame", f"SELECT claim_id, {FEATURE_LIST}, denial_label FROM features")
def _(L):
    return modelling.training_frame(L.gold(columns=MODEL_COLUMNS))


@query("ml4_holdout_split", """SELECT CAST(held AS INT) AS held_out, denial_label, count(*) AS n FROM (
  SELECT denial_label, CAST(concat('0x', substr(sha256(concat(claim_id, '|42')), 1, 8)) AS UBIGINT) / 4294967296.0 < 0.3 AS held FROM features) x GROUP BY ALL""")
def _(L):
    frame = modelling.training_frame(L.gold(columns=MODEL_COLUMNS))
    return frame.groupBy(modelling.holdout(F.col("claim_id")).alias("held_out"), "denial_label").agg(F.count(F.lit(1)).alias("n"))


_FITTED = """SELECT '{m}' AS model_name, 13 AS feature_count, count(*) AS evaluated, count(*) FILTER (denial_label = 1) AS positives, 1 AS rates_agree, 1 AS area_in_range
  FROM (SELECT denial_label, CAST(concat('0x', substr(sha256(concat(claim_id, '|42')), 1, 8)) AS UBIGINT) / 4294967296.0 < 0.3 AS held FROM features) x WHERE held"""


def _fitted(model, test: DataFrame, name: str) -> DataFrame:
    """What any fit must satisfy: it scores every held-out row, and its rates follow from its counts."""
    found = modelling.report(modelling.evaluate(modelling.scored(model, test)), name)
    counts = {k: F.col(f"confusion_matrix.{k}") for k in ("true_negatives", "false_positives", "false_negatives", "true_positives")}
    positives = counts["true_positives"] + counts["false_negatives"]
    rates = (F.abs(F.col("recall") * positives - counts["true_positives"]) < 1e-6) & F.col("precision").between(0, 1) & (F.col("recall_at_high") <= 1)
    return found.select("model_name", "feature_count", sum(counts.values()).alias("evaluated"), positives.alias("positives"),
                        rates.alias("rates_agree"), F.col("roc_auc").between(0.4, 1.0).alias("area_in_range"))


@query("ml5_logistic_evaluation", _FITTED.format(m="logistic_regression"))
def _(L):
    train, test = modelling.split(modelling.training_frame(L.stored_inputs))
    return _fitted(modelling.fit_logistic(train), test, "logistic_regression")


@query("ml6_boosted_evaluation", _FITTED.format(m="boosted_trees"))
def _(L):
    train, test = modelling.split(modelling.training_frame(L.stored_inputs))
    return _fitted(modelling.fit_boosted(train), test, "boosted_trees")


@query("ml7_tuned_parameters")
def _(L):
    train, _ = modelling.split(modelling.training_frame(L.stored_inputs))
    _, best = modelling.tune_boosted(train)
    return L.spark.createDataFrame(sorted((k, float(v)) for k, v in best.items()), "parameter string, value double")


def _model_scores(L: Layers) -> DataFrame:
    """Three fixed scores per claim, so that every metric has an exact answer."""
    f = modelling.fill_features(L.gold(columns=MODEL_COLUMNS)).select(
        F.col(M.TARGET).alias("label"), F.col("provider_risk_score").alias("risk"),
        F.greatest("amount_to_benchmark_ratio", F.lit(0.0)).alias("ratio"))
    scores = {
        "ratio": F.least(F.col("ratio") / 4.0, F.lit(1.0)),
        "provider": F.col("risk"),
        "informed": F.least(F.lit(1.0), F.when(F.col("label") == 1, 0.75).otherwise(0.1) + F.col("risk") / 4.0),
    }
    pairs = F.array(*(F.struct(F.lit(n).alias("model_name"), v.alias("probability")) for n, v in scores.items()))
    return f.select("label", F.inline(pairs))


_METRICS = "model_name, accuracy, precision, recall, f1, recall_at_high, roc_auc"


@query("ml8_evaluation", f"SELECT {_METRICS}, tn, fp, fn, tp FROM metrics")
def _(L):
    return modelling.evaluate(_model_scores(L), ["model_name"]).withColumn("roc_auc", F.round("roc_auc", 9))


@query("ml9_recall_at_high", "SELECT tp_high / (tp + fn) AS recall_at_high FROM confusion WHERE model_name = 'informed'")
def _(L):
    return modelling.recall_at_high(_model_scores(L).where(F.col("model_name") == "informed"))


@query("ml10_confusion_matrix", "SELECT model_name, tn, fp, fn, tp FROM confusion")
def _(L):
    return modelling.confusion(_model_scores(L), ["model_name"]).drop("tp_high")


_RANKED = f"SELECT {_METRICS}, CAST(recall_at_high >= 0.8 AND precision >= 0.7 AND roc_auc >= 0.85 AS INT) AS meets_thresholds FROM metrics"


@query("ml11_release_gate", f"SELECT model_name, meets_thresholds FROM ({_RANKED}) r")
def _(L):
    metrics = modelling.evaluate(_model_scores(L), ["model_name"])
    return metrics.select("model_name", modelling.passes_gate().alias("meets_thresholds"))


@query("ml12_model_selection", f"SELECT model_name FROM ({_RANKED}) r ORDER BY meets_thresholds DESC, recall_at_high DESC, roc_auc DESC, model_name LIMIT 1")
def _(L):
    return modelling.best_model(modelling.evaluate(_model_scores(L), ["model_name"])).select("model_name")


@query("ml13_evaluation_report", """SELECT 'informed' AS model_name, accuracy, precision, recall, recall_at_high, f1, roc_auc, tn, fp, fn, tp,
  CAST(recall_at_high >= 0.8 AND precision >= 0.7 AND roc_auc >= 0.85 AS INT) AS meets_thresholds, 13 AS feature_count FROM metrics WHERE model_name = 'informed'""")
def _(L):
    metrics = modelling.evaluate(_model_scores(L).where(F.col("model_name") == "informed").drop("model_name"))
    out = modelling.report(metrics.withColumn("roc_auc", F.round("roc_auc", 9)), "informed")
    counts = {"true_negatives": "tn", "false_positives": "fp", "false_negatives": "fn", "true_positives": "tp"}
    return out.select("*", *(F.col(f"confusion_matrix.{k}").alias(v) for k, v in counts.items())).drop("confusion_matrix", "features")


_COEF = {"amount_to_benchmark_ratio": 0.5, "provider_claim_count_30d": -0.25, "provider_risk_score": 4.0, "is_amount_missing": 1.0}


@query("ml14_feature_attribution", f"""SELECT claim_id, {', '.join(f'round({w} * ({c} - m_{c}), 6) AS contribution_{c}' for c, w in _COEF.items())} FROM features,
  (SELECT {', '.join(f'sum(CAST({c} AS DECIMAL(30,12))) / count(*) AS raw_{c}, CAST(sum(CAST({c} AS DECIMAL(30,12))) AS DOUBLE) / count(*) AS m_{c}' for c in _COEF)} FROM features) m""")
def _(L):
    frame = modelling.training_frame(L.stored_inputs)
    means = frame.agg(*((F.sum(F.col(c).cast("decimal(30,12)")).cast("double") / F.count(F.lit(1))).alias(c) for c in _COEF))
    out = modelling.contributions(frame, _COEF, means).drop("top_features")
    return out.select("claim_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "claim_id"))


@query("ml15_batch_scores")
def _(L):
    features = L.stored_inputs
    train, _ = modelling.split(modelling.training_frame(features))
    return modelling.score(modelling.fit_logistic(train), features)


@query("ml16_risk_tiers", "SELECT model_name, CASE WHEN probability < 0.3 THEN 'LOW' WHEN probability < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, count(*) AS n FROM model_scores GROUP BY ALL")
def _(L):
    return _model_scores(L).groupBy("model_name", modelling.risk_tier(F.col("probability")).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


# --- Specified in the documents ------------------------------------------------------------

_FLAGS = (("missing_billed_amount", "is_amount_missing"), ("missing_procedure_code", "is_procedure_missing"), ("over_benchmark", "high_cost_flag"),
          ("provider_location_missing", "provider_location_missing"), ("severity_procedure_mismatch", "severity_procedure_mismatch"),
          ("specialty_diagnosis_mismatch", "coalesce(specialty_diagnosis_mismatch, false)"))


@query("doc1_rule_flags", f"""SELECT claim_id, array_to_string(f, '|') AS rule_flags, len(f) AS flag_count FROM (SELECT claim_id,
  list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS)}], lambda x: x IS NOT NULL) AS f FROM gold) x""")
def _(L):
    return flags.claim_flags(L.gold())


_SIDES = """SELECT CAST(billed_amount AS DOUBLE) AS v, date < DATE '1998-07-01' AS base FROM t_claims WHERE billed_amount IS NOT NULL"""
_PSI_COUNTS = f"""SELECT len(list_filter(edges, lambda e: e < v)) AS bucket, count(*) FILTER (base) AS baseline_rows, count(*) FILTER (NOT base) AS current_rows
  FROM ({_SIDES}) s, (SELECT quantile_disc(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM ({_SIDES}) b WHERE base) q GROUP BY 1"""


def _drift_counts(L: Layers) -> DataFrame:
    claims = L.stored("claims").select("date", F.col("billed_amount").cast("double").alias("v"))
    cut = F.to_date(F.lit("1998-07-01"))
    return drift.drift_buckets(claims.where(F.col("date") < cut), claims.where(F.col("date") >= cut), "v")


@query("doc2_drift_buckets", _PSI_COUNTS)
def _(L):
    return _drift_counts(L)


@query("doc2_stability_index", f"""SELECT psi, CAST(psi > 0.2 AS INT) AS alert FROM (SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM (
  SELECT greatest(baseline_rows / sum(baseline_rows) OVER (), 0.0001) AS e, greatest(current_rows / sum(current_rows) OVER (), 0.0001) AS a FROM ({_PSI_COUNTS}) c) x) y""")
def _(L):
    return drift.stability_index(_drift_counts(L))


@query("doc3_quarantine_alerts", f"""SELECT dataset, round(quarantine_row_count / (silver_row_count + quarantine_row_count) * 100, 2) AS quarantine_pct,
  CAST(round(quarantine_row_count / (silver_row_count + quarantine_row_count) * 100, 2) > 5.0 AS INT) AS alert FROM ({_status_sql('(SELECT count(*) FROM chunks)')}) s""")
def _(L):
    return quality.quarantine_alerts(_status(L))


@query("doc4_nearest_chunks", """SELECT query_id, rank, match_id, round(similarity, 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS match_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS similarity,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) DESC, r.vec_id) AS INT) AS rank
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) x WHERE rank <= 5""")
def _(L):
    rows = L.source("embeddings")
    found = retrieval.nearest(rows.where(F.col("vec_id") % 20 == 0), rows, 5)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("doc5_revenue_funnel", """SELECT 'billed' AS stage, CAST(sum(billed_amount) AS DOUBLE) AS amount FROM t_claims
  UNION ALL SELECT 'allowed', CAST(sum(allowed_amount) AS DOUBLE) FROM t_claims UNION ALL SELECT 'paid', CAST(sum(paid_amount) AS DOUBLE) FROM t_claims""")
def _(L):
    return analytics.revenue_funnel(analytics.adjudication_summary(L.trusted("claims")))


@query("doc6_prediction_audit")
def _(L):
    features = L.stored_inputs
    train, _ = modelling.split(modelling.training_frame(features))
    return modelling.prediction_audit(modelling.score(modelling.fit_logistic(train), features), "logistic-1", L.as_of)


@query("doc7_masked_claims", f"SELECT {', '.join(f'CASE WHEN {c} IS NOT NULL THEN concat(substr({c}, 1, 1), {chr(39)}***{chr(39)}) END AS {c}' for c in _HASHED)}, {', '.join(_OPEN)} FROM bronze_claims")
def _(L):
    return privacy.protect(L.raw("claims").select(*M.CLAIMS.columns), privacy.phi_columns("claims"), privacy.MASK)


@query("doc8_benchmark_coverage", """SELECT count(*) AS claims, count(claim_procedure_code) AS claims_with_procedure, count(expected_cost) AS claims_with_benchmark,
  round(count(expected_cost) / nullif(count(*), 0) * 100, 2) AS coverage_pct FROM enriched""")
def _(L):
    return analytics.benchmark_coverage(_enriched(L))


@query("doc9_keep_latest_upsert", "SELECT claim_id, _row_id FROM ranked_claims WHERE rn = 1 OR claim_id IS NULL")
def _(L):
    claims = silver.clean_claims(L.raw("claims")).select("claim_id", *M.AUDIT, "_row_id")
    old = F.col("_pipeline_run_id") < "run-1998"
    return upsert(claims.where(old), claims.where(~old), M.CLAIMS.keys).select("claim_id", "_row_id")


# --- Sinks ---------------------------------------------------------------------------------


@query("snk3_published_rows", "SELECT diagnosis_code, category, severity FROM t_diagnosis")
def _(L):
    """Rows published in place of others; a job that dies in between changes nothing."""
    name = f"published_{uuid.uuid4().hex[:12]}.diagnosis"
    L.spark.sql(f"CREATE DATABASE {name.split('.')[0]}")
    rows = L.trusted("diagnosis").select("diagnosis_code", "category", "severity")
    publish(rows.limit(1), name)
    publish(rows, name)
    try:
        publish(rows.withColumn("severity", F.raise_error(F.col("diagnosis_code")).cast("string")), name)
    except PySparkException:
        pass
    found = stage(L.spark.read.table(name), "published")
    L.spark.sql(f"DROP DATABASE {name.split('.')[0]} CASCADE")
    return found


@query("snk_clustered_stage", "SELECT claim_id, CAST(date AS VARCHAR) AS date, rule_name FROM v_claims")
def _(L):
    rows = L.validated("claims").select("claim_id", "date", F.col("_failure.rule_name").alias("rule_name"))
    return stage(clustered(stage(rows, "claims_to_cluster"), M.CLAIMS.cluster), "clustered_claims")
