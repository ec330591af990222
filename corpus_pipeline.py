"""From raw documents to clean token ids in five stages.

Each stage takes the documents its predecessor kept, as a stored table, and all but the last return the
columns of ``documents``. Columns a stage does not know pass through it. Every stage works on an empty table
and on null ids and texts as its operator states: null and empty texts pass every stage and have no ids in the last,
texts of any length are read whole, repeated rows are copies of each other, and no name of a column can clash.
Stages that run Python bound the Arrow batches of the session, so that tasks do not hold many texts at once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, dartminhash, decontaminate, pii, quality
from claimloom.llm.common import bounded, free_name, table
from claimloom.llm.components import sized
from claimloom.sinks import stage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality machine, fitted on the labels, does not reject."""
    bounded(spark)
    metadata = [c for c in ("n_chars",) if c in docs.columns]
    machine = quality.train(docs, table(spark, sf_dir, "labels"), metadata=metadata)
    name = free_name(docs, "score")
    return quality.with_score(docs, machine, name, metadata=metadata).filter(F.col(name) >= quality.KEEP_AT).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: of those with the least id, the first stored; null ids are last.

    Ids may repeat or be null, so rows are told apart by a key of their own.
    """
    bounded(spark)
    key = free_name(docs, "row_key")
    keyed = stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed-documents")
    found = dartminhash.groups(keyed, id_col=key).select(F.col("doc_id").alias(key), "class_id")
    placed = stage(found.join(keyed.select(key, F.col("doc_id").alias("id")), key), "near-groups")
    # Structs are compared field by field: rows with an id come before those without.
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col(key)))
    firsts = placed.groupBy("class_id").agg(first[key].alias("first"), F.count("*").alias("n")).filter("n > 1").select("class_id", "first")
    copies = placed.join(sized(stage(firsts, "near-firsts")), "class_id").filter(F.col(key) != F.col("first")).select(key)
    return keyed.join(sized(stage(copies, "near-copies")), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly such passages go."""
    return decontaminate.decontaminate(docs, table(bounded(spark), sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    bounded(spark)
    return pii.masked(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their text, and the text as those ids decode."""
    bounded(spark)
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    done = bpe.encode_decode(packed, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, id_col="row")
    return done.select(
        *[F.col(f"doc_id.`{c}`").alias(c) for c in others],
        F.decode("decoded", "UTF-8").alias("text"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("PII", mask_personal_data),
    ("byte-level BPE", to_tokens),
]

#: A fitted classifier, similarity groups and merges by rank are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
