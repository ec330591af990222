"""Silver refreshed by what has landed since the last refresh, key bucket by key bucket.

Landed rows are kept once more in ``keyed_*`` tables, partitioned by a hash of their business key and by their
batch. All rows that can compete for a key lie in one bucket, so the buckets of new rows, and those of claims
whose provider or diagnosis became known, are all that a refresh has to judge again. Only their partitions of the
trusted and quarantine tables are replaced. Claims lie, within their bucket, in parts by their key: they are landed,
judged and written again without a shuffle of their rows. A ledger holds the batches that are done; it is written last, and
every write before it puts the same rows into the same partitions when it is repeated.

Which claim buckets refer to a provider or diagnosis is kept too, in slots by that key, so new reference keys
find their claims without reading the claims.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import cleaning as C
from claimloom.model import BATCH, CLAIMS, ROW_ID
from claimloom.namespace import Namespace
from claimloom.operators.newest import DEALT, deal_out, mark_newest_bucketed
from claimloom.plans import silver
from claimloom.sinks import append, replace_partitions, scratch, stage
from claimloom.sources.snapshots import bronze_snapshot

BUCKET, SLOT = "_bucket", "_slot"
#: Choose it so that a bucket's rows fit a task or two; it is fixed once a ledger exists.
BUCKETS = 64
#: Parts of claims, of which every bucket has as many, for a first refresh of many rows, and how many rows are many to
#: a part. A part is judged by one task.
PARTS, ROWS_PER_PART = 128, 100_000
#: So many batches are written at once without a sort by part.
WRITERS = 4
#: A task that writes fewer rows than this into all parts leaves files too small, and so does one that leaves fewer than
#: these to a file, once all cores have a task.
ROWS_PER_TASK, ROWS_PER_FILE = 250_000, 16_384
#: Rows kept and rows judged are written once for each refresh that touches them.
CODEC = "zstd"
ORDER = ("providers", "diagnosis", "cost", "claims")
REFERENCES = {"providers": "provider_id", "diagnosis": "diagnosis_code"}
#: Business keys as the validation compares them.
KEYS: dict[str, Callable[[], tuple[Column, ...]]] = {
    "claims": lambda: (C.code("claim_id"),),
    "providers": lambda: (C.code("provider_id"),),
    "diagnosis": lambda: (C.code("diagnosis_code"),),
    "cost": lambda: (C.code("procedure_code"), C.title("region")),
}


def ledger(namespace: Namespace) -> str:
    return namespace.silver("refresh_ledger")


def keyed(namespace: Namespace, dataset: str) -> str:
    return namespace.silver(f"keyed_{dataset}")


def reference_index(namespace: Namespace) -> str:
    return namespace.silver("claims_by_reference")


def bucket_of(dataset: str, buckets: int) -> Column:
    """Bucket of a row's key. Rows with a missing key part compete with none and are spread by their row id."""
    parts = KEYS[dataset]()
    whole = F.lit(True)
    for part in parts:
        whole = whole & part.isNotNull()
    return F.pmod(F.when(whole, F.xxhash64(*parts)).otherwise(F.xxhash64(ROW_ID)), F.lit(buckets)).cast("int")


def parts(buckets: int, rows: int) -> int:
    """Parts that all claims lie in, a multiple of ``buckets``; fixed by the first refresh."""
    return buckets * max(1, min(PARTS // buckets, rows // (buckets * ROWS_PER_PART)))


def parts_of(spark: SparkSession, table: str) -> int:
    """Parts that a kept table was made with."""
    return int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])


def writing_tasks(rows: int, held: int, cores: int) -> int:
    """Tasks that write ``rows`` into ``held`` parts, a file for each task and part."""
    return max(1, min(rows // ROWS_PER_TASK, max(cores, rows // (held * ROWS_PER_FILE))))


def partitions(spark: SparkSession, table: str) -> list[dict[str, str]]:
    """The partitions of a table, from the catalog alone."""
    if not spark.catalog.tableExists(table):
        return []
    return [dict(p.split("=", 1) for p in r["partition"].split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]


def pending(spark: SparkSession, namespace: Namespace) -> dict[str, list[int]]:
    """Batches of each Bronze table that no refresh has taken up yet."""
    done: dict[str, set[int]] = {name: set() for name in ORDER}
    if spark.catalog.tableExists(ledger(namespace)):
        for row in spark.read.table(ledger(namespace)).select("dataset", "batch").distinct().collect():
            done[row["dataset"]].add(row["batch"])
    landed = {name: {int(p[BATCH]) for p in partitions(spark, namespace.bronze(name))} for name in ORDER}
    return {name: sorted(landed[name] - done[name]) for name in ORDER}


def refresh_changes(
    spark: SparkSession, namespace: Namespace, buckets: int = BUCKETS, as_of: Column | None = None
) -> dict[str, list[int]]:
    """Bring Silver up to the landed batches; returns the buckets that were judged again, by dataset.

    The tables end up with the rows that a refresh of everything would give. Without a new batch nothing is read
    or written. The first refresh takes up all batches.
    """
    namespace.create(spark, ("silver", "quarantine"))
    now = F.lit(spark.sql("SELECT current_timestamp() AS t").first()["t"]) if as_of is None else as_of
    new = pending(spark, namespace)
    for name, batches in new.items():
        if batches:
            _key_rows(spark, namespace, name, batches, buckets)
    # Bucket numbers come from partition names: at most ``buckets`` of them for each dataset.
    touched = {
        name: {int(p[BUCKET]) for p in partitions(spark, keyed(namespace, name)) if int(p[BATCH]) in new[name]} for name in ORDER
    }
    touched["claims"] |= _claims_of_new_references(spark, namespace, new, touched, buckets)
    for name in ORDER:
        if touched[name]:
            with scratch(spark):
                _judge(spark, namespace, name, touched[name], now)
    rows = [(name, batch, buckets) for name, batches in new.items() for batch in batches]
    if rows:
        append(spark.createDataFrame(rows, "dataset string, batch int, buckets int").coalesce(1), ledger(namespace))
    return {name: sorted(numbers) for name, numbers in touched.items()}


def _key_rows(spark: SparkSession, namespace: Namespace, name: str, batches: Sequence[int], buckets: int) -> None:
    """Add the rows of new batches to the keyed table, and their references to the index."""
    landed = namespace.bronze(name)
    spark.catalog.refreshTable(landed)
    rows = spark.read.table(landed) if ROW_ID in spark.read.table(landed).columns else bronze_snapshot(spark, landed)
    rows = rows.where(F.col(BATCH).isin(*batches))
    if name == "claims":
        _key_claims(rows, keyed(namespace, name), len(batches), buckets)
        rows = spark.read.table(keyed(namespace, name)).where(F.col(BATCH).isin(*batches))
        pairs = F.array(*[F.struct(F.lit(n).alias("kind"), C.code(key).alias("key")) for n, key in REFERENCES.items()])
        found = rows.select(BATCH, F.col(BUCKET).alias("claim_bucket"), F.inline(pairs)).where("key IS NOT NULL").distinct()
        found = found.select("kind", "key", "claim_bucket", _slot(buckets).alias(SLOT), BATCH)
        replace_partitions(found.hint("rebalance", SLOT), reference_index(namespace), (SLOT, BATCH))
    else:
        rows = rows.withColumn(BUCKET, bucket_of(name, buckets))
        replace_partitions(rows.hint("rebalance", BUCKET), keyed(namespace, name), (BUCKET, BATCH), CODEC)


def _key_claims(rows: DataFrame, table: str, batches: int, buckets: int) -> None:
    """Keep claims under their clean key, in parts by it.

    Each task writes its rows straight into the parts they belong to, so wide rows are neither shuffled nor sorted.
    Buckets take the hash of bucketed tables, so no part holds rows of two buckets, those of hot keys excepted.
    """
    spark, key = rows.sparkSession, CLAIMS.keys[0]
    if spark.catalog.tableExists(table) and DEALT not in spark.read.table(table).columns:
        raise ValueError(f"{table} was kept in an older layout: drop the keyed and Silver tables of claims and the ledger, and refresh anew")
    rows = rows.withColumn(key, KEYS["claims"]()[0])
    together = F.when(F.col(key).isNull(), F.col(DEALT)).otherwise(F.lit(0).cast("long"))
    count = rows.count()
    held = parts_of(spark, table) if spark.catalog.tableExists(table) else parts(buckets, count)
    tasks = writing_tasks(count, held, spark.sparkContext.defaultParallelism)
    with scratch(spark):
        placed = deal_out(rows, CLAIMS.keys).withColumn(BUCKET, F.pmod(F.hash(key, together), F.lit(buckets)).cast("int"))
        writers = max(buckets, PARTS) * min(batches, WRITERS)
        replace_partitions(placed.coalesce(tasks), table, (BUCKET, BATCH), CODEC, (held, key, DEALT), writers)


def _slot(buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")


def _claims_of_new_references(
    spark: SparkSession, namespace: Namespace, new: dict[str, list[int]], touched: dict[str, set[int]], buckets: int
) -> set[int]:
    """Buckets of claims that name a provider or diagnosis which no earlier batch held."""
    out: set[int] = set()
    if not spark.catalog.tableExists(reference_index(namespace)):
        return out
    for name, key in REFERENCES.items():
        if not new[name]:
            continue
        rows = _bucket_rows(spark, namespace, name, touched[name]).select(C.code(key).alias("key"), F.col(BATCH).isin(*new[name]).alias("new"))
        fresh = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("new").alias("new")).where("new").select(F.lit(name).alias("kind"), "key")
        with scratch(spark):
            fresh = stage(fresh.withColumn(SLOT, _slot(buckets)), "fresh-references")
            slots = [r[SLOT] for r in fresh.select(SLOT).distinct().collect()]
            if slots:
                index = spark.read.table(reference_index(namespace)).where(F.col(SLOT).isin(*slots))
                named = index.join(fresh.drop(SLOT), ["kind", "key"]).select("claim_bucket").distinct()
                out |= {r["claim_bucket"] for r in named.collect()}
    return out


def _bucket_rows(spark: SparkSession, namespace: Namespace, name: str, numbers: Iterable[int]) -> DataFrame:
    """The kept rows of some buckets; the filter names partitions, so no other file is read."""
    return spark.read.table(keyed(namespace, name)).where(F.col(BUCKET).isin(*sorted(numbers)))


def _reference(spark: SparkSession, namespace: Namespace, name: str) -> DataFrame:
    """The distinct keys of a reference table, stored so that their size is known; an empty one if nothing has landed."""
    table, key = keyed(namespace, name), REFERENCES[name]
    if spark.catalog.tableExists(table):
        # Claims are not shuffled before they meet these keys, so no shuffle would tell in time that the keys are few.
        return stage(silver.known_keys(spark.read.table(table), key, "_known").select(key), f"known_{name}")
    return spark.createDataFrame([], f"{key} string")


def _judge(spark: SparkSession, namespace: Namespace, name: str, numbers: set[int], now: Column) -> None:
    """Validate the rows of some buckets and put them in place of these buckets' partitions."""
    rows = _bucket_rows(spark, namespace, name, numbers).drop(BATCH)
    if name == "claims":
        # Both outcomes are judged from the kept rows: their parts need no shuffle, and judging costs no disk.
        references = (_reference(spark, namespace, n) for n in REFERENCES)
        marked = mark_newest_bucketed(rows, CLAIMS.keys, buckets=parts_of(spark, keyed(namespace, name)))
        checked = silver.judged_claims(silver.clean_claims(marked), *references, now)
    else:
        checks = {"providers": silver.validated_providers, "diagnosis": silver.validated_diagnosis, "cost": silver.validated_cost}
        checked = stage(checks[name](rows, now), f"changed_{name}")
    layout = {namespace.silver(name): silver.trusted_rows(checked), namespace.quarantine(name): silver.quarantined_rows(checked, name, now)}
    for table, frame in layout.items():
        before = _files(spark, table, numbers)
        frame = frame if name == "claims" else frame.hint("rebalance", BUCKET)
        replace_partitions(frame, table, (BUCKET,), CODEC, writers=len(numbers))
        # A bucket that still holds a file from before got no rows: they are all on the other side now.
        for number in {number for path, number in _files(spark, table, numbers).items() if path in before}:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({BUCKET} = {number})")


def _files(spark: SparkSession, table: str, numbers: Iterable[int]) -> dict[str, int]:
    """Names of the files of some buckets of a table, each with its bucket."""
    if not spark.catalog.tableExists(table):
        return {}
    spark.catalog.refreshTable(table)
    paths = spark.read.table(table).where(F.col(BUCKET).isin(*sorted(numbers))).inputFiles()
    return {path: int(path.rsplit(f"/{BUCKET}=", 1)[1].split("/", 1)[0]) for path in paths}


def refreshed(spark: SparkSession, table: str) -> DataFrame:
    """A table that :func:`refresh_changes` keeps, without its bucket numbers."""
    return spark.read.table(table).drop(BUCKET)
