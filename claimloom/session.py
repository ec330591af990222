"""Session settings and input spreading that the wide cleaning projections need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HotSpot never compiles a method above 8,000 bytecodes. A wide projection fused into one
# larger method would run interpreted, several times slower than split generated code.
# A join whose hot key is cut into several tasks may need one more exchange after it; take it.
# Where every partition of the smaller side is known to be small, hash it instead of sorting the wide rows.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
}
#: Below the first size an input is dealt out unasked; from the second on its files have splits enough.
SMALL_INPUT, LARGE_INPUT = 1 << 25, 1 << 30


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's size estimate of a scan; None where it cannot be read. Runs no job."""
    try:
        return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    except Exception:
        return None


def balanced(df: DataFrame, tasks: int) -> bool:
    """Whether the partitions hold rows for ``tasks`` tasks, none more than twice its share. Reads no column."""
    # A row for each partition of an input below LARGE_INPUT, at most some hundreds.
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    return len(sizes) >= tasks and max(sizes) * tasks <= 2 * sum(sizes)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input evenly over the cores.

    A file of one row group is one task, however many cores there are. Files that have splits enough are left as
    they are: a shuffle of the whole input would gain nothing.
    """
    size = estimated_bytes(df)
    if size is None or size >= LARGE_INPUT:
        return df
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, 64)
    if size >= SMALL_INPUT and balanced(df, tasks):
        return df
    return df.repartition(tasks)
