"""Yearly files taken in as they come, and windows over event time.  An extension: the batch loader doesn't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, fmt: str = "csv", timeout: int = 300) -> None:
    """Appends the files of ``folder`` that weren't taken in yet to the Parquet folder ``out``, each exactly once."""
    stream = spark.readStream.schema(schema).format(fmt).option("header", True).load(folder)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination(timeout)
    finally:
        q.stop()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per window of event time; works on a table and on a stream alike.

    Repeated events (same id) count once; on a stream ``late`` bounds how long they are remembered.
    """
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = events.withWatermark("ts", late).dropDuplicates(["event_id", "ts"]) if events.isStreaming else events.dropDuplicates(["event_id", "ts"])
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
