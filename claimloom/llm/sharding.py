"""Shards of near-equal bytes: longest-processing-time scheduling of groups through a heap.

Rows with equal texts stay together. The scheduler must not see every group of a large corpus, so
groups below a grain (one part in ``GRAIN`` of a shard) are first bundled by hash into at most
``shards * GRAIN`` bundles. Groups of the grain and above are at most as many, because their sizes add
up to the total. These items, sorted by size, go one after another to the least-loaded shard. The same
rule holds at every size: on a small table the grain is below any row and each group is an item.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.sinks import stage

GRAIN = 1000
ROW_OVERHEAD = 16
SLOT_BLOCK = 100_000


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. Ties: the earlier item first, the lower shard first."""
    loads = [(0, s) for s in range(shards)]
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = loads[0]
        placed[i] = shard
        heapq.heapreplace(loads, (load + sizes[i], shard))
    return placed


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 16; a null text has none and the checksum of no bytes. Null texts
    are one group, apart from empty ones. Slots run gapless from 0 in each shard: items one after another,
    rows of an item by id. Repeated rows get a slot each. An empty table gives an empty result. Columns
    other than id and text are not read. A shard is larger than the others only where one group alone is.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    bytes_ = F.coalesce(text, F.lit("")).cast("binary")
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(bytes_) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            F.when(text.isNotNull(), F.unhex(F.sha2(bytes_, 256))).otherwise(F.lit(b"")).alias("group"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    grain, bundles = max(1, total // (shards * GRAIN)), shards * GRAIN
    groups = stage(
        rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn(
            "item",
            F.when(F.col("bytes") >= grain, F.base64("group")).otherwise(
                F.concat(F.lit("#"), F.pmod(F.xxhash64("group"), F.lit(bundles)))
            ),
        ),
        "shard-groups",
    )
    # At most bundles + total / grain rows come to the driver, however many documents there are.
    items = groups.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("item").collect()
    placed = longest_first([r["bytes"] for r in items], shards)
    filled = [0] * shards
    plan = []
    for r, s in zip(items, placed):
        plan.append((r["item"], s, filled[s], 1 + r["n"] // SLOT_BLOCK))
        filled[s] += r["n"]
    plan_frame = spark.createDataFrame(plan, "item string, shard int, start long, blocks long")
    heavy = F.broadcast(plan_frame.filter(~F.col("item").startswith("#")).select(F.unbase64("item").alias("group"), F.col("item").alias("own")))
    bundle = F.concat(F.lit("#"), F.pmod(F.xxhash64("group"), F.lit(bundles)))
    placed_rows = (
        rows.join(heavy, "group", "left")
        .withColumn("item", F.coalesce("own", bundle))
        .join(F.broadcast(plan_frame), "item")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    )
    # Rows of one item are numbered in blocks of about SLOT_BLOCK rows, so a hot text is shared by many tasks.
    before = Window.partitionBy("item").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed_rows.filter(F.col("blocks") > 1)
        .groupBy("item", "block")
        .agg(F.count("*").alias("n"))
        .select("item", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    )
    within = F.row_number().over(Window.partitionBy("item", "block").orderBy("doc_id", "group"))
    numbered = placed_rows.withColumn("row", within)
    if any(p[3] > 1 for p in plan):
        numbered = numbered.join(offsets, ["item", "block"], "left")
    else:
        numbered = numbered.withColumn("skip", F.lit(0).cast("long"))
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.coalesce("skip", F.lit(0)) + F.col("row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
