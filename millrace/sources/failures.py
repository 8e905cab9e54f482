"""The failure corpus: an append-only JSON table of failed questions and their corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "_id string, timestamp timestamp, nl_query string, failed_sql string, error string, retries int, corrected_sql string, source string, corrected_at timestamp"


def latest(records: DataFrame) -> DataFrame:
    """The latest record of each id, oldest first."""
    w = Window.partitionBy("_id").orderBy(F.col("timestamp").desc(), F.col("corrected_sql").asc_nulls_last())
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy("timestamp", "_id")


class FailureStore:
    """log, save_correction, list, get and export over a folder of JSON files. Writes only append, so a lost task leaves the old records whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def records(self) -> DataFrame:
        return latest(self.spark.read.schema(SCHEMA).json(self.path))

    def log(self, nl_query: str, failed_sql: str, error: str, retries: int = 0, source: str = "batch") -> str:
        import datetime
        import hashlib

        key = hashlib.sha256(f"{nl_query}\x1f{failed_sql}".encode()).hexdigest()[:16]
        self._append([(key, datetime.datetime.now(), nl_query, failed_sql, error, retries, None, source, None)])
        return key

    def save_correction(self, key: str, sql: str) -> bool:
        import datetime

        found = self.get(key)
        if found is None:
            return False
        now = datetime.datetime.now()
        self._append([(key, now, found["nl_query"], found["failed_sql"], found["error"], found["retries"], sql, found["source"], now)])
        return True

    def get(self, key: str):
        return self.records().filter(F.col("_id") == key).first()

    def list(self, corrected: bool | None = None, most: int = 100) -> DataFrame:
        r = self.records()
        if corrected is not None:
            r = r.filter(F.col("corrected_sql").isNotNull() if corrected else F.col("corrected_sql").isNull())
        return r.limit(most)

    def export(self, path: str) -> None:
        """The corrected failures as pairs, one JSON line each."""
        self.records().filter("corrected_sql is not null").select("nl_query", F.col("corrected_sql").alias("sql"), F.lit("failures").alias("source")).write.mode("overwrite").json(path)
