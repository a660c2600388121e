"""Tables that outlive a lost executor: written to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete a query's shuffle files when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes of a batch that Python gets, of which a task holds several copies; and what it is where the session doesn't set it.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Folders of all tables of written() that were not deleted yet, in their order.
_tables: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, a temporary one in local mode, as in tests, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="timberline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends, and not when the driver happens to collect garbage; for writes, whose rows are read from their table alone."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def small_batches(spark: SparkSession) -> None:
    """From now on batches that Python gets have some BATCH_BYTES at most, unless the session says otherwise; a larger row is a batch of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def written(df: DataFrame, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """The rows of df from a Parquet table; what follows doesn't recompute what came before. partition_by: the last column, if the table is to have a folder for each of its values."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{folder(spark)}/timberline-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    with cleaned(spark):
        (writer if partition_by is None else writer.partitionBy(partition_by)).parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path in _tables:
            _tables.remove(path)
            delete(df.sparkSession, path)


def mark() -> int:
    """How many tables there are; release() of it deletes those that are written from now on."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes all tables written since a mark(), once the results that read them are stored."""
    while len(_tables) > since:
        delete(spark, _tables.pop())
