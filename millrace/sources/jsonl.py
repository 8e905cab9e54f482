"""JSON lines, tolerant or strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """The records of a JSON-lines folder or file. Malformed lines are left out, or raise if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return full.filter(F.col("_bad").isNull()).drop("_bad")


def write_runs(df: DataFrame, path: str, run_id: str) -> None:
    """Appends run rows under their run's own folder."""
    df.write.mode("append").json(f"{path}/run_id={run_id}")
