"""Extension: price rows that arrive as files, folded into the catalog batch by batch.

Late repeats of a row are dropped within the watermark; each micro-batch is an
upsert of a versioned table, so a batch that is run again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.duplicates import identity
from ..operators.writes import standardized, upsert
from ..plans.catalog import SCHEMA
from ..sources.versions import VersionedTable


def price_stream(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Rows of JSON files as they appear, without repeats of a configuration and import time."""
    rows = spark.readStream.schema(SCHEMA).json(folder).withColumn("seen_at", F.to_timestamp("imported_at"))
    return rows.withColumn("_key", F.to_json(identity())).withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["_key", "imported_at"]).drop("_key")


def ingest(stream: DataFrame, table: VersionedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts every micro-batch of standardised rows into the table."""

    def fold(batch: DataFrame, _: int) -> None:
        new = standardized(batch)
        rows = upsert(table.read(), new).drop("change") if table.exists() else new
        table.write(rows)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; works on streams and on tables."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
