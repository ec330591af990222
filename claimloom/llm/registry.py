"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import alignment, bpe, centroids, dartminhash, decontaminate, hnsw, langid, ngram_lm, packing, pii, quality, sharding, url_filter
from claimloom.llm.common import remainder, table
from claimloom.llm.url_filter import Rule

RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality.train(docs, labels.filter(remainder("doc_id", 4) != 2), metadata=["n_chars"])
    scored = quality.score(docs, machine, metadata=["n_chars"])
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP_AT).cast("int").alias("predicted"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(remainder("doc_id", 4) != 2))
    return langid.predict(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    )
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("row_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def _joined(spans) -> Column:
    written = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(written, ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row_id").alias("doc_id"),
        *map(count, ("email", "ip", "card", "phone")),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule, rhost, rpath, says) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
urls AS (SELECT DISTINCT host, path FROM parts),
hits AS (
  SELECT host, path, rule, says, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS k
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, p.host, p.path, rule, coalesce(says, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.host = h.host AND p.path = h.path AND k = 1
"""

def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.groups(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(words, i, i + least(10, len(words)) - 1), ' ') AS w, least(10, len(words)) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM folded, sizes)),
found AS (SELECT doc_id, i, r.n, item_id FROM runs r JOIN windows USING (w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql(k: int = 40, rounds: int = 5, dimension: int = 64) -> str:
    """Plain rounds: every vector against every centroid."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v ORDER BY c LIMIT {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS v, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT r, vec_id, v.v AS x, c, CAST(list_sum(list_transform(list_zip(v.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{n})
  GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
m{n} AS MATERIALIZED (
  SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v
  FROM (SELECT best.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, range(1, {dimension + 1}) AS t(i) GROUP BY best.c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INT) AS "cluster", best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_embeddings": op6_embeddings,
    "op7_pii": op7_pii,
    "op8_language_model": op8_language_model,
    "op9_url_filter": op9_url_filter,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {"op5_decontamination": OP5_SQL, "op9_url_filter": OP9_SQL, "op12_centroids": _op12_sql()}

if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
