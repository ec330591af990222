"""The registered queries against their SQL on the smallest tables.

``CHECK_ALL=1`` runs all of them; otherwise one of each family runs.
"""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SAMPLE = ("snk2_incremental_claims", "snk2_incremental_quarantine", "src1_record_forms", "aud4_marked_records", "src4_bronze_snapshot", "exp1_9_claims_expectations", "cln3_normalize_title", "val4_claim_rules", "val11_reconciliation", "txt8_policy_chunks",
          "gld16_claim_features", "anl10_denial_reasons", "ops2_quarantine_summary", "ops5_user_actions_struct", "prf5_amount_summary",
          "lbl3_applied_labels", "doc4_nearest_chunks", "ml8_evaluation", "doc2_stability_index")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return float(v) if isinstance(v, int) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()) if os.environ.get("CHECK_ALL") else SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = entry_module.queries()[name](spark, SMALL)
    result = db.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    ours = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    theirs = Counter(tuple(value(v) for v in r) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    df = entry_module.entry(spark)
    assert len(df.columns) == 34 and df.count() > 0


def test_every_query_has_a_distinct_name():
    names = list(entry_module.queries())
    assert len(names) == len(set(names)) > 120 and set(entry_module.oracle_sql()) <= set(names)
