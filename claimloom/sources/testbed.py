"""Claim-shaped raw tables derived from the generic order, event and document tables.

Each derivation is one SQL statement in the subset of SQL that Spark and other engines share, so
a checker can run the same text. Raw values are text, as they land, and defects (blank and NULL
values, wrong dates, unknown references, contradictory labels, replaced rows, broken markup) are
placed by remainders of the row's own numbers, so they are spread over whole tables and grow with
them. ``{name}`` stands for a source table.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.cleaning import code
from claimloom.model import CLAIMS, FEATURES, GOLD_COLUMNS, TARGET
from claimloom.operators.newest import SLOT, key_slot
from claimloom.plans import gold, silver
from claimloom.session import configure, spread
from claimloom.sinks import stage, stage_bucketed

CLAIMS_SQL = """
SELECT
  CASE WHEN l_partkey % 211 = 7 THEN '  '
       WHEN l_partkey % 5 = 0 THEN concat(' c', l_orderkey, '-', l_linenumber, ' ')
       ELSE concat('C', l_orderkey, '-', l_linenumber) END AS claim_id,
  CASE WHEN l_partkey % 223 = 5 THEN '' ELSE concat('P', o_custkey) END AS patient_id,
  CASE WHEN l_partkey % 227 = 3 THEN NULL
       WHEN l_partkey % 229 = 11 THEN 'PR-UNLISTED'
       ELSE concat('pr', l_suppkey) END AS provider_id,
  CASE WHEN l_partkey % 233 = 2 THEN ''
       WHEN l_partkey % 239 = 4 THEN 'D-UNLISTED'
       ELSE lower(concat('D-', p_type)) END AS diagnosis_code,
  CASE WHEN l_partkey % 4 = 1 THEN NULL
       WHEN l_partkey % 31 = 0 THEN ' '
       ELSE p_brand END AS procedure_code,
  CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN NULL
       WHEN (l_partkey + l_linenumber) % 41 = 5 THEN 'abc'
       WHEN (l_partkey + l_linenumber) % 43 = 6 THEN concat('-', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING))
       ELSE concat(' ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) END AS billed_amount,
  CASE WHEN (l_partkey + l_suppkey) % 101 = 9 THEN replace(CAST(CAST(l_shipdate AS DATE) AS STRING), '-', '/')
       WHEN (l_partkey + l_suppkey) % 103 = 1 THEN ''
       ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date,
  CASE WHEN l_partkey % 127 = 1 THEN 'PENDING'
       WHEN l_returnflag = 'R' THEN 'DENIED' ELSE 'approved ' END AS claim_status,
  CASE WHEN (l_partkey + l_suppkey) % 113 = 3 THEN NULL
       WHEN (l_returnflag = 'R') = ((l_partkey + l_suppkey) % 109 = 8) THEN
            CASE WHEN l_linenumber % 2 = 0 THEN 'NONE' ELSE 'none' END
       WHEN l_partkey % 4 = 0 THEN 'MISSING_PROCEDURE'
       WHEN l_partkey % 4 = 1 THEN 'MISSING_BILLED_AMOUNT'
       WHEN l_partkey % 4 = 2 THEN 'OVER_BENCHMARK'
       ELSE 'MEDICAL_REVIEW' END AS denial_reason_code,
  CASE WHEN (l_partkey + l_linenumber) % 131 = 2 THEN ''
       ELSE CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
                 AS DECIMAL(18,2)) AS STRING) END AS allowed_amount,
  CASE WHEN l_returnflag = 'R' THEN '0.00'
       ELSE CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
                 AS DECIMAL(18,2)) AS STRING) END AS paid_amount,
  CASE WHEN (l_partkey + l_linenumber) % 107 = 4 THEN 'maybe'
       WHEN l_returnflag = 'R' THEN CASE l_linenumber % 3 WHEN 0 THEN 'Y' WHEN 1 THEN ' yes' ELSE '1' END
       ELSE CASE l_linenumber % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'no ' ELSE '0' END END AS is_denied,
  CASE WHEN l_partkey % 137 = 3 THEN NULL
       WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS follow_up_required,
  CASE WHEN l_partkey % 139 = 6 THEN 'malformed' END AS _rescued_data,
  CAST(l_shipdate AS TIMESTAMP) AS _ingested_at,
  concat('landing/claims/', substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7), '-', l_suppkey % 7, '.csv') AS _source_file,
  concat('run-', substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7)) AS _pipeline_run_id,
  concat(l_partkey, '/', l_suppkey, '/', CAST(l_quantity AS BIGINT), '/', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) AS _row_id
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {part} ON l_partkey = p_partkey
"""

PROVIDERS_SQL = """
SELECT
  CASE WHEN s_suppkey % 47 = 9 THEN ' ' ELSE concat('pr', s_suppkey) END AS provider_id,
  CASE WHEN s_suppkey % 41 = 5 THEN '' ELSE concat(' dr supplier ', s_suppkey, ' md') END AS doctor_name,
  CASE s_suppkey % 6 WHEN 0 THEN 'heart' WHEN 1 THEN 'bone' WHEN 2 THEN 'SKIN ' WHEN 3 THEN 'ob/gyn'
       WHEN 4 THEN 'ent' ELSE 'diabetes' END AS specialty,
  CASE WHEN s_acctbal < 0 THEN NULL WHEN s_suppkey % 37 = 4 THEN '' ELSE lower(n_name) END AS location,
  CASE WHEN s_suppkey % 43 = 2 THEN 'malformed' END AS _rescued_data,
  TIMESTAMP '2024-01-01 00:00:00' AS _ingested_at,
  'landing/providers/base.csv' AS _source_file,
  'run-2024-01' AS _pipeline_run_id,
  concat('base/', s_suppkey) AS _row_id
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT concat(' PR', s_suppkey), 'dr former', 'bone', NULL, NULL,
  TIMESTAMP '2023-06-01 00:00:00', 'landing/providers/old.csv', 'run-2023-06', concat('old/', s_suppkey)
FROM {supplier} WHERE s_suppkey % 10 = 3
UNION ALL
SELECT concat('PR', s_suppkey), NULL, 'heart', 'nation_1', NULL,
  TIMESTAMP '2024-03-01 00:00:00', 'landing/providers/new.csv', 'run-2024-03', concat('new/', s_suppkey)
FROM {supplier} WHERE s_suppkey % 50 = 7
"""

DIAGNOSIS_SQL = """
SELECT
  concat('D-', p_type) AS diagnosis_code,
  CASE p_type WHEN 'STANDARD' THEN 'heart' WHEN 'MEDIUM' THEN 'bone' WHEN 'PROMO' THEN 'fever'
       WHEN 'LARGE' THEN 'skin' WHEN 'SMALL' THEN 'diabetes' ELSE 'ent' END AS category,
  CASE p_type WHEN 'STANDARD' THEN 'high' WHEN 'MEDIUM' THEN ' HIGH' WHEN 'PROMO' THEN 'medium'
       WHEN 'SMALL' THEN 'High' ELSE 'low' END AS severity,
  CAST(NULL AS STRING) AS _rescued_data,
  TIMESTAMP '2024-01-01 00:00:00' AS _ingested_at,
  'landing/diagnosis/base.csv' AS _source_file,
  'run-2024-01' AS _pipeline_run_id,
  concat('base/', p_type) AS _row_id
FROM {part} GROUP BY p_type
UNION ALL
SELECT concat(' d-', lower(p_type)), CASE WHEN p_type = 'SMALL' THEN ' ' ELSE 'bone' END,
  CASE WHEN p_type = 'LARGE' THEN NULL ELSE 'low' END, CASE WHEN p_type = 'LARGE' THEN 'malformed' END,
  TIMESTAMP '2023-06-01 00:00:00', 'landing/diagnosis/old.csv', 'run-2023-06', concat('old/', p_type)
FROM {part} WHERE p_type IN ('SMALL', 'LARGE', 'MEDIUM') GROUP BY p_type
UNION ALL
SELECT '', 'unknown', 'low', CAST(NULL AS STRING),
  TIMESTAMP '2024-02-01 00:00:00', 'landing/diagnosis/new.csv', 'run-2024-02', concat('new/', min(p_partkey))
FROM {part}
"""

COST_SQL = """
SELECT
  CASE WHEN (brand + n_nationkey) % 29 = 6 THEN ' ' ELSE lower(p_brand) END AS procedure_code,
  CASE WHEN (brand + n_nationkey) % 17 = 3 THEN '0'
       ELSE CAST(CAST(top * factor * CAST(0.8 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS STRING) END AS average_cost,
  CASE WHEN (brand + n_nationkey) % 19 = 4 THEN 'n/a'
       ELSE CAST(CAST(top * factor AS DECIMAL(18,2)) AS STRING) END AS expected_cost,
  CASE WHEN (brand + n_nationkey) % 23 = 5 THEN NULL ELSE upper(n_name) END AS region,
  CAST(NULL AS STRING) AS _rescued_data,
  TIMESTAMP '2024-01-01 00:00:00' AS _ingested_at,
  'landing/cost/base.csv' AS _source_file,
  'run-2024-01' AS _pipeline_run_id,
  concat('base/', p_brand, '/', n_nationkey) AS _row_id
FROM (SELECT b.p_brand, b.brand, b.top, n_name, n_nationkey, CAST(1 + (b.brand * 7 + n_nationkey) % 40 AS DECIMAL(6,2)) AS factor
      FROM (SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS brand, CAST(max(p_retailprice) AS DECIMAL(18,2)) AS top
            FROM {part} GROUP BY p_brand) b
      JOIN {nation} ON n_nationkey % 2 = b.brand % 2) x
UNION ALL
SELECT p_brand, '100', '120.5', concat(' ', n_name), CAST(NULL AS STRING),
  TIMESTAMP '2023-06-01 00:00:00', 'landing/cost/old.csv', 'run-2023-06', concat('old/', p_brand, '/', n_nationkey)
FROM (SELECT p_brand, n_name, n_nationkey
      FROM (SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS brand FROM {part} GROUP BY p_brand) b
      JOIN {nation} ON n_nationkey % 2 = b.brand % 2 AND n_nationkey % 5 = b.brand % 5) y
"""

POLICIES_SQL = """
SELECT
  concat('policies/', source, '/', CASE WHEN doc_id % 12 = 5 THEN doc_id - 1 ELSE doc_id END, '.txt') AS path,
  CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP) AS modificationTime,
  CAST(length(text) AS BIGINT) AS length,
  CASE WHEN doc_id % 53 = 7 THEN '' WHEN doc_id % 59 = 8 THEN ' \n\t ' WHEN doc_id % 61 = 9 THEN NULL ELSE text END AS content,
  CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-01-15 00:00:00' END AS _ingested_at,
  concat('landing/policies/', source, '.txt') AS _source_file,
  concat('run-', doc_id % 4) AS _pipeline_run_id,
  concat('doc/', doc_id) AS _row_id
FROM (SELECT doc_id, text, concat('p', (doc_id - doc_id % 2) % 20) AS source FROM {documents}) d
UNION ALL
SELECT
  concat('policies/web/', page_id, '.html'),
  CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP),
  CAST(length(html) AS BIGINT),
  CASE WHEN page_id % 17 = 4 THEN concat(html, '<div class="cut') WHEN page_id % 19 = 5 THEN '<p> <br/> </p>' ELSE html END,
  TIMESTAMP '2024-03-01 00:00:00', url, 'run-web', concat('page/', page_id)
FROM {pages}
"""

EVENT_LOG_SQL = """
SELECT
  ts AS timestamp,
  CASE event_id % 5 WHEN 0 THEN 'create_update' WHEN 1 THEN 'update_progress' WHEN 2 THEN 'flow_progress'
       WHEN 3 THEN 'user_action' ELSE 'maintenance' END AS event_type,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 11 = 0 THEN 'WARN' ELSE 'INFO' END AS level,
  concat('event ', event_id % 13) AS message,
  CASE WHEN event_id % 4 = 0 THEN concat('user', user_id) END AS user_identity,
  concat('{{', CASE WHEN event_id % 3 = 0 THEN concat('"update_id":"u', event_id % 97, '",') ELSE '' END,
         CASE WHEN event_id % 7 = 0 THEN concat('"user_name":"owner', user_id % 5, '",') ELSE '' END,
         '"pipeline_id":"pl', event_id % 3, '"}}') AS origin,
  concat('{{"update_id":"d', event_id % 89, '",',
    CASE WHEN event_id % 5 = 1 THEN concat('"update_progress":{{"state":"', upper(event_type), '"}},') ELSE '' END,
    CASE WHEN event_id % 5 = 2 THEN concat('"flow_progress":{{"status":"RUNNING","metrics":{{"dataset":"',
           CASE event_id % 3 WHEN 0 THEN 'claims' WHEN 1 THEN 'cost' ELSE 'audit' END, '"}}',
           CASE WHEN event_id % 2 = 0 THEN concat(',"data_quality":{{"expectations":[{{"name":"claim_id_not_null","dataset":"claims","passed_records":',
                  CAST(floor(value) AS BIGINT), ',"failed_records":', event_id % 9, '}},{{"name":"region_not_null","dataset":"cost","passed_records":',
                  user_id, ',"failed_records":0}}]}}') ELSE '' END, '}},') ELSE '' END,
    CASE WHEN event_id % 10 = 3 THEN concat('"user_action":{{"action":"', event_type, '","user_name":"u', user_id % 11, '"}},') ELSE '' END,
    CASE WHEN event_id % 6 = 0 THEN concat('"dataset":"', CASE event_id % 4 WHEN 0 THEN 'providers' ELSE 'policies' END, '",') ELSE '' END,
    CASE WHEN event_id % 9 = 0 THEN '"error_code":"E_DETAIL",' ELSE '' END,
    '"state":"', lower(event_type), '"}}') AS details,
  CASE WHEN event_type = 'error' THEN concat('{{"error_code":"E', event_id % 17, '","message":"', CASE event_id % 4 WHEN 0 THEN '[STEP_FAILED] ' WHEN 1 THEN '{{step}} ' ELSE '' END, 'failed step ', event_id % 23, '"}}') END AS error
FROM {events}
"""

REVIEW_SQL = """
SELECT DISTINCT concat('C', l_orderkey, '-', l_linenumber) AS claim_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
WHERE o_orderpriority = '1-URGENT'
"""

STATEMENTS = {
    "claims": (CLAIMS_SQL, ("lineitem", "orders", "part")),
    "providers": (PROVIDERS_SQL, ("supplier", "nation")),
    "diagnosis": (DIAGNOSIS_SQL, ("part",)),
    "cost": (COST_SQL, ("part", "nation")),
    "policies": (POLICIES_SQL, ("documents", "pages")),
    "event_log": (EVENT_LOG_SQL, ("events",)),
    "review_ids": (REVIEW_SQL, ("lineitem", "orders")),
}

EVENT_STRUCTS = {
    "origin": "struct<update_id:string,pipeline_id:string,user_name:string>",
    "details": (
        "struct<update_id:string,state:string,dataset:string,error_code:string,"
        "user_action:struct<action:string,user_name:string>,update_progress:struct<state:string>,"
        "flow_progress:struct<status:string,metrics:struct<dataset:string>,data_quality:struct<expectations:"
        "array<struct<name:string,dataset:string,passed_records:bigint,failed_records:bigint>>>>>"
    ),
    "error": "struct<error_code:string,message:string>",
}

AS_OF = "2024-06-01 00:00:00"

FACTS = ("lineitem", "documents", "pages", "events")
DIMENSIONS = ("providers", "diagnosis", "cost")
MODEL_COLUMNS = ("claim_id", *FEATURES, TARGET)
#: Buckets of stored claims at most, the rows that make one, and those of a file. There are no fewer buckets than cores.
BUCKETS, BUCKET_ROWS, FILE_ROWS = 200, 500_000, 16_384


class Layers:
    """The layers over one folder of source tables.

    Frames are lazy. ``stored_*`` frames are written once to the shared folder and read back, as
    a layer's tables are in a real run: reference tables that many plans join, so that their true
    size is known to the planner, and fact tables that one plan reads more than once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder
        self.as_of = F.to_timestamp(F.lit(AS_OF))
        self._frames: dict[tuple, DataFrame] = {}
        self._lock, self._locks = Lock(), {}

    def _once(self, key: tuple, build) -> DataFrame:
        with self._lock:
            own = self._locks.setdefault(key, Lock())
        with own:
            if key not in self._frames:
                self._frames[key] = build()
            return self._frames[key]

    def source(self, table: str) -> DataFrame:
        def read() -> DataFrame:
            df = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
            return spread(df) if table in FACTS else df

        return self._once(("source", table), read)

    def raw(self, name: str) -> DataFrame:
        statement, sources = STATEMENTS[name]
        return self._once(
            ("raw", name), lambda: self.spark.sql(statement, **{s: self.source(s) for s in sources})
        )

    def stored_raw(self, name: str) -> DataFrame:
        return self._once(("stored raw", name), lambda: stage(self.raw(name), f"bronze_{name}", codec="zstd"))

    def slotted_claims(self) -> DataFrame:
        """Landed claims, stored in buckets by the slot of their clean key: their contest shuffles nothing."""
        def build() -> DataFrame:
            slotted = self.raw("claims").withColumn(SLOT, key_slot([code(k) for k in CLAIMS.keys]))
            return self._bucketed(slotted, "bronze_claims", (SLOT,))

        return self._once(("slotted", "claims"), build)

    def _bucketed(self, claims: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
        """A table of claims, stored in buckets. Its writing tasks are few enough that files do not get small."""
        held = self.spark.read.parquet(f"{self.folder}/lineitem.parquet").count()  # from the footers
        cores = self.spark.sparkContext.defaultParallelism
        buckets = max(cores, min(BUCKETS, held // BUCKET_ROWS))
        tasks = max(cores, held // (buckets * FILE_ROWS))
        return stage_bucketed(claims.coalesce(tasks), name, buckets, by, codec="zstd")

    def bronze(self) -> dict[str, DataFrame]:
        return {n: self.raw(n) for n in ("claims", "providers", "diagnosis", "cost", "policies")}

    def _validate(self, name: str) -> DataFrame:
        if name == "claims":
            # Claims are read for their contest and again for their rows: landed once, not joined together twice.
            landed = self._together(lambda build: build(), (
                self.slotted_claims, *(partial(self.stored_raw, n) for n in ("providers", "diagnosis"))))
            return silver.validated_claims(*landed, self.as_of)
        if name == "policy_chunks":
            return silver.validated_documents(self.raw("policies"), self.as_of)
        check = {"providers": silver.validated_providers, "diagnosis": silver.validated_diagnosis, "cost": silver.validated_cost}
        return check[name](self.raw(name), self.as_of)

    def validated(self, name: str) -> DataFrame:
        return self._once(("validated", name), lambda: self._validate(name))

    def trusted(self, name: str) -> DataFrame:
        if name == "policy_chunks":
            return silver.policy_chunks(self.validated(name))
        return silver.trusted_rows(self.validated(name))

    def stored(self, name: str) -> DataFrame:
        """A trusted table, stored."""
        return self._once(("stored", name), lambda: stage(self.trusted(name), f"silver_{name}", codec="zstd"))

    @staticmethod
    def _together(build, names) -> list[DataFrame]:
        """Store several tables by concurrent jobs."""
        with ThreadPoolExecutor(max_workers=4) as pool:
            return list(pool.map(build, names))

    def references(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Trusted providers, diagnosis and cost, stored."""
        return tuple(self._together(self.stored, DIMENSIONS))

    def quarantined(self, name: str) -> DataFrame:
        if name == "policy_chunks":
            return silver.quarantined_documents(self.validated(name), self.as_of)
        return silver.quarantined_rows(self.validated(name), name, self.as_of)

    def stored_claims(self, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """Some columns of the trusted claims, stored; what is not asked for is not carried through validation either.

        They may lie in buckets by some of them.
        """
        kept = tuple(c for c in self.trusted("claims").columns if c in columns)

        def build() -> DataFrame:
            rows = self.trusted("claims").select(*kept)
            if by:
                return self._bucketed(rows, "silver_claims", by)
            return stage(rows, "silver_claims", codec="zstd")

        return self._once(("claims", kept, tuple(by)), build)

    def gold(self, approx: bool = False, columns: Sequence[str] = GOLD_COLUMNS) -> DataFrame:
        needed = {*gold.CLAIM_INPUTS, *columns}
        claims, *references = self._together(lambda build: build(), (
            lambda: self.stored_claims(needed, gold.ACTIVITY_KEYS), *(partial(self.stored, name) for name in DIMENSIONS)))
        return gold.gold_features(claims, *references, self.as_of, approx, columns)

    @property
    def stored_inputs(self) -> DataFrame:
        """What the model reads of the Gold table, stored."""
        return self._once(("stored", "inputs"), lambda: stage(self.gold(columns=MODEL_COLUMNS), "model_inputs", codec="zstd"))

    def event_log(self, shape: str = "json") -> DataFrame:
        """The event log with its nested columns as JSON text or as structs."""
        log = self.raw("event_log")
        if shape == "json":
            return log
        return log.withColumns({c: F.from_json(c, t) for c, t in EVENT_STRUCTS.items()})
