"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of one Arrow batch on its way to Python. Spark's own, 10,000 rows and 64 MB, would have every task
#: hold tens of megabytes of texts twice, outside the heap and in the worker.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 22}
SLICE = 256


def bounded(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches no larger than ``BATCH_BOUNDS``; smaller settings stay."""
    for key, most in BATCH_BOUNDS.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(docs: DataFrame, work: Callable[..., pa.Array], returns: str, columns: list[Column], name: str) -> DataFrame:
    """``docs`` and, as column ``name``, what ``work`` makes of slices of ``columns`` (a list of values for each).

    Rows stay with Spark, which sets them aside while Python works; only ``columns`` go there and only the new
    values come back.
    """

    def apply(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            starts = range(0, max(1, len(batch[0])), SLICE)
            yield pa.concat_arrays([work(*(column.slice(at, SLICE).to_pylist() for column in batch)) for at in starts])

    # The argument that is always null makes one column a tuple too. A result that is used twice is made once.
    return docs.withColumn(name, F.arrow_udf(apply, returns).asNondeterministic()(*columns, F.lit(None).cast("int")))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many signs as it takes to differ from all columns of ``docs``, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def with_id(docs: DataFrame, id_col: str, name: str, ddl: str) -> T.StructType:
    """Schema of ``name``, of the type of the id column whatever that is, and the columns of ``ddl``."""
    return T.StructType([T.StructField(name, docs.schema[id_col].dataType), *T.StructType.fromDDL(ddl).fields])


def changed(done: DataFrame, new_text: Column, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs``, with ``new_text`` where it is not null, and ``n_chars`` of such a text."""

    def column(name: str) -> Column:
        old = F.col(f"`{name}`")
        if name == text_col:
            return F.coalesce(new_text, old).alias(name)
        if name == "n_chars":
            return F.when(new_text.isNotNull(), F.length(new_text)).otherwise(old).cast(docs.schema[name].dataType).alias(name)
        return old

    return done.select(*[column(c) for c in docs.columns])
