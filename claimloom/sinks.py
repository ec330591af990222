"""Writing tables: overwrite with staging, clustering for data skipping, and shared stages."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITE_CONF = "spark.sql.sources.partitionOverwriteMode"
WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"
#: Ranges of a column on the space-filling curve, a power of two, and the rows their edges are taken from.
STEPS = 64
#: Stands between a published name and the number of a version.
VERSION = "__v"
SAMPLED = 4096
CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_folder: dict[str, str] = {}
#: The number of files a task writes at once is a setting of the session.
_writers = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder.

    Only a local session without that setting gets a folder of its own, removed at exit.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="claimloom-")
        atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
    return _own_folder[app]


_open = threading.local()
_unowned: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_unowned() -> None:
    for spark, path in _unowned:
        with suppress(Exception):  # the session may be gone
            delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the stages that this thread wrote inside it.

    Frames that read them must have been written out by then. A stage with ``keep`` belongs to the
    block around this one, if there is any.
    """
    stack = _open.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _own(spark: SparkSession, path: str, keep: bool) -> None:
    """Have ``path`` deleted with the block it is written in, or when the program ends."""
    stack = _open.__dict__.get("stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(path)
    else:
        _unowned.append((spark, path))


def stage(df: DataFrame, name: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that later uses scan files instead of recomputing.

    The stage lies in the shared folder, so losing an executor costs nothing, and column pruning
    and filters reach its scans. It goes with the :func:`scratch` block it was written in; outside of
    any block a frame may read it at any time, so it goes when the program ends. Wide text takes a third less with the
    ``codec`` zstd.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage/{name}-{uuid.uuid4().hex}"
    _own(spark, path, keep)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, buckets: int, columns: Sequence[str], codec: str | None = None, keep: bool = False) -> DataFrame:
    """A :func:`stage` whose rows lie in ``buckets`` by ``columns``, so that plans by them shuffle nothing.

    Each task writes its rows straight into all buckets, at once and unsorted. The catalog knows the files only while
    they are written and resolved; they are read by their path.
    """
    spark = df.sparkSession
    table = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/stage/{name}-{table}"
    _own(spark, path, keep)
    written = df.write.option("path", path).bucketBy(buckets, *columns)
    with _writers, setting(spark, WRITERS_CONF, str(buckets)):
        (written.option("compression", codec) if codec else written).saveAsTable(table)
    try:
        return spark.read.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def stage_all(frames: Mapping[str, DataFrame], workers: int = 4) -> dict[str, DataFrame]:
    """Stage several frames; up to ``workers`` of them at a time as concurrent Spark jobs."""
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(frames)))) as pool:
        stored = pool.map(lambda item: stage(item[1], item[0]), frames.items())
        return dict(zip(frames, stored))


def _steps(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Values that cut each column into about ``STEPS`` ranges of equal size, from the ``SAMPLED`` rows of least hash."""
    rows = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(SAMPLED).collect()
    found = {}
    for column in columns:
        values = sorted(r[column] for r in rows if r[column] is not None)
        found[column] = sorted({values[len(values) * i // STEPS] for i in range(1, STEPS)}) if values else []
    return found


def space_filling(df: DataFrame, columns: Sequence[str]) -> Column:
    """Place of a row on a curve that winds through the ranges of all the columns together.

    The bits of each column's range number take turns, so rows that lie near each other on the curve lie near each
    other in every column. NULL is in the first range.
    """
    places = [_place(F.col(c), edges, n, len(columns)) for n, (c, edges) in enumerate(_steps(df, columns).items())]
    return reduce(Column.bitwiseOR, places)


def _place(column: Column, edges: Sequence, turn: int, turns: int) -> Column:
    """Number of edges that a value reaches, its bits set apart for ``turns`` columns; found by halving."""
    def apart(number: int) -> int:
        return sum((number >> bit & 1) << (bit * turns + turn) for bit in range(STEPS.bit_length() - 1))

    def between(least: int, most: int) -> Column:
        if least == most:
            return F.lit(apart(least)).cast("long")
        middle = (least + most + 1) // 2
        return F.when(column >= F.lit(edges[middle - 1]), between(middle, most)).otherwise(between(least, middle - 1))

    return F.when(column.isNull(), F.lit(0).cast("long")).otherwise(between(0, len(edges)))


def clustered(df: DataFrame, columns: Sequence[str], files: int | None = None) -> DataFrame:
    """Rows ranged and sorted so that file and row-group statistics can skip data by any of ``columns``.

    One column is ranged by itself. Several are ranged along a space-filling curve over their ranges: behind a
    unique first column, plain sorting would leave the others scattered over all files. Their ranges come from a
    bounded sample, which can only make files uneven, and rows that share a range are sorted by the columns.
    ``df`` is read twice more: store what is costly.
    """
    order: list = list(columns)
    if len(columns) > 1:
        order = [space_filling(df, columns), *columns]
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def overwrite(df: DataFrame, table: str, cluster: Sequence[str] = ()) -> str:
    """Replace ``table`` and its schema with ``df``."""
    out = clustered(df, cluster) if cluster else df
    out.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)
    return table


def _versions(spark: SparkSession, name: str) -> list[str]:
    """Tables that hold versions of a published name, full names."""
    database, _, short = name.rpartition(".")
    found = spark.catalog.listTables(database or None)
    return [f"{database}.{t.name}" if database else t.name for t in found if re.fullmatch(rf"{re.escape(short)}{VERSION}[0-9a-f]{{32}}", t.name)]


def publish(df: DataFrame, name: str, cluster: Sequence[str] = ()) -> str:
    """Show the rows of ``df`` under ``name`` once all of them are written.

    Rows go to a table of their own; then one statement turns the view ``name`` to it. Until then readers see the old
    rows, also if the job dies while it writes, and ``df`` may itself read ``name``. The version before stays until
    the next call, so that reads under way can end; what else is left over goes. One writer at a time for a name. A plain
    table of that name becomes its first version.
    """
    spark = df.sparkSession
    held = _versions(spark, name)
    version = overwrite(df, f"{name}{VERSION}{uuid.uuid4().hex}", cluster)
    shown = None
    if spark.catalog.tableExists(name):
        if spark.catalog.getTable(name).tableType == "VIEW":
            text = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
            shown = next((v for v in held if v.rpartition(".")[2] in text), None)
        else:
            shown = f"{name}{VERSION}{uuid.uuid4().hex}"
            spark.sql(f"ALTER TABLE {name} RENAME TO {shown}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for old in held:
        if old != shown:
            spark.sql(f"DROP TABLE IF EXISTS {old}")
    return name


def replace_self(df: DataFrame, table: str, cluster: Sequence[str] = ()) -> str:
    """Replace ``table`` with a frame that reads it: written aside first, then swapped in."""
    with scratch(df.sparkSession):
        return overwrite(stage(df, table.replace(".", "_")), table, cluster)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def replace_partitions(
    df: DataFrame,
    table: str,
    by: Sequence[str],
    codec: str | None = None,
    bucketed: tuple[int, str] | None = None,
    writers: int = 0,
) -> str:
    """Put the rows in place of the table's partitions that they belong to; all others stay as they are.

    New columns are added to the table first; columns it has and ``df`` lacks become NULL. A table that is made here
    keeps its ``codec``, and with ``bucketed`` the rows of a partition lie in so many buckets of a column. A task that
    writes at most ``writers`` files at a time does not sort its rows for them.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        made = df.write.partitionBy(*by)
        made = made.option("compression", codec) if codec else made
        made = made.bucketBy(*bucketed) if bucketed else made
        with setting(spark, WRITERS_CONF, str(writers)):
            made.saveAsTable(table)
        return table
    held = spark.read.table(table).schema
    fresh = [f for f in df.schema.fields if f.name not in held.names]
    if fresh:
        added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
        held = spark.read.table(table).schema
    ordered = df.select(*(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in held.fields))
    with setting(spark, OVERWRITE_CONF, "dynamic"), setting(spark, WRITERS_CONF, str(writers)):
        ordered.write.mode("overwrite").insertInto(table)
    return table


def append(df: DataFrame, table: str) -> str:
    df.write.mode("append").saveAsTable(table)
    return table


def publish_all(frames: Mapping[str, DataFrame], workers: int = 4) -> dict[str, str]:
    """Publish several tables; up to ``workers`` writes run at a time as concurrent Spark jobs."""
    if workers <= 1 or len(frames) < 2:
        return {table: publish(df, table) for table, df in frames.items()}
    with ThreadPoolExecutor(max_workers=min(workers, len(frames))) as pool:
        written = pool.map(lambda item: publish(item[1], item[0]), frames.items())
        return dict(zip(frames, written))
