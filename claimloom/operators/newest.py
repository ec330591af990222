"""Newest-row-wins marking per business key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import NEWEST_FIRST, ROW_ID
from claimloom.operators.lookups import lookup
from claimloom.sinks import stage, stage_bucketed

PRIORITY = "_row_priority"
COPIES_PER_CHUNK = 10_000
#: Rows of one key that a task may meet, and the slots in which keys with more of them are looked for.
HOT_ROWS, SLOTS = 1_000_000, 4096
#: Numbers the rows that do not lie with the others of their key.
DEALT = "_dealt"
#: The slot of a row's key in a stored table whose buckets are by it.
SLOT = "_key_slot"


def number_copies(df: DataFrame, id_column: str = ROW_ID) -> DataFrame:
    """Give identical rows distinct ids, for frames that carry no row id of their own.

    Copies are counted (map-side combined), then written out again in numbered chunks that are
    spread by a shuffle before the last step, so a row with very many copies is neither held
    nor emitted by one task.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    last_chunk = F.floor((F.col("_copies") - 1) / COPIES_PER_CHUNK)
    chunked = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    first = F.col("_chunk") * COPIES_PER_CHUNK + 1
    final = F.least(F.col("_copies"), first + COPIES_PER_CHUNK - 1)
    numbered = chunked.repartition("_chunk", *df.columns).withColumn(
        id_column, F.explode(F.sequence(first, final))
    )
    return numbered.drop("_copies", "_chunk")


def mark_newest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] | None = None,
    row_id: str = ROW_ID,
    store_contest: bool = False,
) -> DataFrame:
    """Add ``_row_priority``: 1 for the newest row of each key, 2 for the rows it replaces.

    Rows are ranked before anything is known about their validity, so an invalid newest row
    still replaces an older valid one. Ties end at ``row_id``, which makes the choice total;
    frames without it get one from :func:`number_copies`. Rows with a NULL key part take part
    in no contest and keep 1.

    Only the largest order value of each contested key is shuffled and joined back, instead of
    sorting every key's rows in one window task. With ``store_contest`` those values are written
    first, from a pass over the key and order columns alone. Their true size is then known: while
    it is below the broadcast threshold the full rows are not shuffled at all, beyond it the two
    are joined by a shuffle. Use it for large inputs of wide rows; it runs a job at once.
    """
    order = list(order) if order is not None else [F.col(c) for c in NEWEST_FIRST]
    added_id = row_id not in df.columns
    if added_id:
        df = number_copies(df, row_id)
    position = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(row_id).alias("id"))
    keyed = reduce(and_, (F.col(k).isNotNull() for k in keys))
    contested = (
        df.where(keyed)
        .groupBy(*keys)
        .agg(F.max(position).alias("_newest"), F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > 1)
        .drop("_rows")
    )
    if store_contest:
        contested = stage(contested, "contested")
    marked = lookup(df, contested, on=keys).withColumn(
        PRIORITY, F.when(position < F.col("_newest"), 2).otherwise(1)
    )
    return marked.drop("_newest", *([row_id] if added_id else []))


def key_slot(keys: Sequence[Column], row_id: str = ROW_ID) -> Column:
    """The slot of a row: by its key, or by its row id where a part of the key is NULL."""
    whole = reduce(and_, (k.isNotNull() for k in keys))
    return F.pmod(F.when(whole, F.xxhash64(*keys)).otherwise(F.xxhash64(row_id)), F.lit(SLOTS)).cast("int")


def hot_newest(df: DataFrame, keys: Sequence[str], position: Column, limit: int, slot: Column | None = None) -> DataFrame | None:
    """The newest position of every key with more than ``limit`` rows; None if there is no such key.

    Rows are counted by slots of the key's hash first: a slot of few rows holds no hot key, so keys are counted only
    in slots of many.
    """
    slot = (F.pmod(F.xxhash64(*keys), F.lit(SLOTS)) if slot is None else slot).alias("_slot")
    counted = df.groupBy(slot).count().where(F.col("count") > limit)
    heavy = [r["_slot"] for r in counted.collect()]  # at most SLOTS numbers
    if not heavy:
        return None
    rows = df.where(slot.isin(heavy)).groupBy(*keys).agg(F.max(position).alias("_newest"), F.count(F.lit(1)).alias("_rows"))
    hot = stage(rows.where(F.col("_rows") > limit).drop("_rows"), "hot-keys")
    return hot if hot.take(1) else None


def mark_newest_grouped(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] | None = None,
    row_id: str = ROW_ID,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What :func:`mark_newest` adds, for large inputs in which many keys have several rows.

    The rows are shuffled once, by key, and compared where they meet; no second shuffle carries their keys and order
    values. Rows with a NULL key part, and those of keys with more than ``hot_rows`` rows, are dealt by their row id
    instead, so a task meets at most that many rows of one key: the newest of a hot key is found by a map-side
    combined maximum, and there are few such keys. ``df`` is read once more for the counts of keys: store it.

    Rows that are stored in buckets by their :func:`key_slot`, in the column ``_key_slot``, lie with those of their key
    and are not shuffled at all, unless there is a hot key.
    """
    order = list(order) if order is not None else [F.col(c) for c in NEWEST_FIRST]
    added_id = row_id not in df.columns
    if added_id:
        df = number_copies(df, row_id)
    position = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(row_id).alias("id"))
    contends = reduce(and_, (F.col(k).isNotNull() for k in keys))
    slotted = SLOT in df.columns
    # Rows without a key have slots all over, so they make none hot; slots alone are read without the keys.
    hot = hot_newest(df if slotted else df.where(contends), keys, position, hot_rows, F.col(SLOT) if slotted else None)
    if slotted and hot is None:
        beside = F.max(position).over(Window.partitionBy(SLOT, *keys))
        marked = df.withColumn(PRIORITY, F.when(contends & (position < beside), 2).otherwise(1))
        return marked.drop(SLOT, *([row_id] if added_id else []))
    df, met, newest = df.drop(SLOT), contends, F.lit(None)
    if hot is not None:
        df = lookup(df, hot, on=keys).withColumnRenamed("_newest", "_hot")
        met, newest = contends & F.col("_hot").isNull(), F.col("_hot")
    # Dealt out here, so that order values are packed for comparison behind the shuffle and cross it only once.
    dealt = df.withColumn("_dealt", F.when(~met, F.xxhash64(row_id)).otherwise(0)).repartition(*keys, "_dealt")
    beside = F.max(position).over(Window.partitionBy(*keys, "_dealt"))
    replaced = contends & (position < F.coalesce(newest, beside))
    marked = dealt.withColumn(PRIORITY, F.when(replaced, 2).otherwise(1))
    return marked.drop("_hot", "_dealt", *([row_id] if added_id else []))


def deal_out(df: DataFrame, keys: Sequence[str], row_id: str = ROW_ID, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_dealt``: 0, so that the rows of a key stay together, but a number of their own for rows that must not.

    These have a NULL key part, or belong to one of the few keys with more than ``hot_rows`` rows in ``df``.
    """
    whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
    hot = hot_newest(df.where(whole), keys, F.struct(row_id), hot_rows)
    if hot is not None:
        df = lookup(df, hot, on=keys)
        whole = whole & F.col("_newest").isNull()
    return df.withColumn(DEALT, F.when(whole, F.lit(0).cast("long")).otherwise(F.xxhash64(row_id).bitwiseOR(F.lit(1)))).drop("_newest")


def mark_newest_bucketed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] | None = None,
    row_id: str = ROW_ID,
    buckets: int | None = None,
) -> DataFrame:
    """What :func:`mark_newest` adds, for a table that is bucketed by ``keys`` and the ``_dealt`` of :func:`deal_out`.

    Rows of a key lie in one bucket, so nothing is shuffled: the newest of each contested key is found from keys
    and order values alone and hashed beside the wide rows, which are not sorted either. Keys whose rows are dealt
    out are few: their newest is found by a map-side combined maximum over all their rows. With ``buckets``, of which the
    table has that many, the newest are stored in them, so that several reads of the result find them once.
    """
    order = list(order) if order is not None else [F.col(c) for c in NEWEST_FIRST]
    position = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(row_id).alias("id"))
    contends = reduce(and_, (F.col(k).isNotNull() for k in keys))
    contested = (
        df.where(contends)
        .groupBy(*keys, DEALT)
        .agg(F.max(position).alias("_newest"), F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > 1)
        .drop("_rows")
    )
    if buckets:
        contested = stage_bucketed(contested, "contested", buckets, (*keys, DEALT), codec="zstd")
    marked, newest = lookup(df, contested.hint("shuffle_hash"), on=[*keys, DEALT]), F.col("_newest")
    dealt = df.where(contends & (F.col(DEALT) != 0)).select(*keys)
    if dealt.take(1):
        known = stage(dealt.distinct().withColumn("_known", F.lit(True)), "dealt-keys")
        met = lookup(df, known, on=keys).where("_known").groupBy(*keys).agg(F.max(position).alias("_hot"))
        marked, newest = lookup(marked, stage(met, "hot-keys"), on=keys), F.coalesce("_hot", "_newest")
    return marked.withColumn(PRIORITY, F.when(position < newest, 2).otherwise(1)).drop("_newest", "_hot", DEALT)


def keep_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    return mark_newest(df, keys, order).where(F.col(PRIORITY) == 1).drop(PRIORITY)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Current rows and changes together, the newest row per key kept."""
    both = current.unionByName(changes, allowMissingColumns=True)
    return keep_newest(both, keys, order)
