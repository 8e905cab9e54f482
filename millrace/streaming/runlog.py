"""Monitoring of runs as they are logged: windowed rates with a watermark, and upserts of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed(log: DataFrame, ts: Column, size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; the same for a batch and a stream."""
    return log.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def stream(spark: SparkSession, path: str, schema: str = SCHEMA, late: str = "2 hours") -> DataFrame:
    """A stream of the log's Parquet files; rows later than ``late`` behind the newest are dropped by the windows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path).withWatermark("ts", late)


def run_once(spark: SparkSession, path: str, out: str, checkpoint: str, schema: str = SCHEMA) -> None:
    """Drains what is there into Parquet windows and ends. A restart goes on from the checkpoint."""
    df = windowed(stream(spark, path, schema), F.col("ts"))
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def upsert_failures(spark: SparkSession, path: str, store: str, checkpoint: str, schema: str = SCHEMA) -> None:
    """Appends each micro-batch's errors to the failure table; its readers take the latest record of each id, so a batch written twice does no harm."""

    def save(batch: DataFrame, _: int) -> None:
        batch.filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("_id"), F.col("ts").alias("timestamp"), F.col("props").alias("error")).write.mode("append").json(store)

    stream(spark, path, schema).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
