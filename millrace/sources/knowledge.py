"""Glossary, few-shot and business-rule files (JSON lines or one JSON list) as chunks of one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of each kind of file. Fixed values.
SCHEMAS = {
    "GLOSSARY": "term string, definition string, related_tables array<string>, domain_tags array<string>",
    "FEW_SHOT": "nl string, sql string, intent string, explanation string",
    "BUSINESS_RULE": "domain_concept string, sql_mapping string, table_context string, description string",
}


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """chunk_id, chunk_type, text, nl_question, expected_sql, referenced_tables; records without their main field are left out.

    A file whose first mark is [ is one list, any other has a record a line.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("v")).first()  # of the first partition: the file's beginning
    raw = spark.read.schema(SCHEMAS[kind]).option("multiLine", bool(first) and first["v"].startswith("[")).json(path)
    if kind == "GLOSSARY":
        made = raw.filter("term is not null").select(
            F.concat_ws(": ", "term", "definition").alias("text"), F.lit(None).cast("string").alias("nl_question"), F.lit(None).cast("string").alias("expected_sql"), F.coalesce("related_tables", F.array().cast("array<string>")).alias("referenced_tables")
        )
    elif kind == "FEW_SHOT":
        made = raw.filter("nl is not null and sql is not null").select(
            F.concat_ws("\n", "nl", "sql").alias("text"), F.col("nl").alias("nl_question"), F.col("sql").alias("expected_sql"),
            F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(r"\b(?:from|join)\s+([a-z_]\w*)"), F.lit(1))).alias("referenced_tables"),
        )
    else:
        made = raw.filter("domain_concept is not null").select(
            F.concat_ws(" | ", "domain_concept", "sql_mapping", "description").alias("text"), F.lit(None).cast("string").alias("nl_question"), F.col("sql_mapping").alias("expected_sql"),
            F.filter(F.split(F.coalesce("table_context", F.lit("")), r"\s*,\s*"), lambda t: t != "").alias("referenced_tables"),
        )
    return made.withColumn("chunk_type", F.lit(kind)).withColumn("chunk_id", F.substring(F.sha2(F.concat_ws(":", "chunk_type", "text"), 256), 1, 32))
