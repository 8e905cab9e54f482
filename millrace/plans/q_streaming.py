"""The run-log windows of the streaming module: a stream over events, drained into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir
from ..streaming.runlog import windowed


def stream_runlog_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the events as a stream, until all that is there is seen, and gives what the windows hold then.

    Windows are complete results of the query so far, so each micro-batch's replace the table's rows of the same window.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = windowed(events, F.col("ts").cast("timestamp"), "1 hour")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")  # a repeated batch writes the same again

    query = rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    made = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").schema(rows.schema).parquet(folder)
    batch = F.regexp_extract(F.input_file_name(), r"/(\d+)/part-[^/]*$", 1).cast("int")
    last = made.withColumn("_b", batch).groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "_b").alias("r"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "r.n", F.round("r.total", 4).alias("total"))


QUERIES = {"stream_runlog_window": stream_runlog_window}
ORACLE_SQL = {
    "stream_runlog_window": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
