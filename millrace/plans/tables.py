"""The tables of a data folder as views, only those that a statement names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sqlx import tokens
from ..sqlx.translate import translate

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Registers the tables that ``sql`` names."""
    named = {t.text.lower() for t in tokens.tokenize(sql) if t.kind == "word"}
    for name in NAMES:
        if name in named:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def postgres(sql: str):
    """A registered query written in PostgreSQL's dialect, run through the translator."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        return spark.sql(translate(sql))

    return run


def catalog_sql() -> str:
    """The driver tables' catalog as common table expressions for an oracle: tabs, cols and fks, in declared order."""
    from ..catalog import driver_catalog

    c = driver_catalog()
    tabs = ", ".join(f"({i}, '{t}')" for i, t in enumerate(c.tables))
    cols = ", ".join(
        f"({i}, '{t.name}', '{x.name}', '{x.type}', '{x.family}', {str(x.primary).lower()}, '{', '.join(sorted(x.allowed or ()))}')" for t in c.tables.values() for i, x in enumerate(t.columns.values())
    )
    fks = ", ".join(f"({i}, '{k.from_table}', '{k.from_columns[0]}', '{k.to_table}', '{k.to_columns[0]}')" for i, k in enumerate(c.foreign_keys))
    return (
        f"tabs(ord, table_name) AS (VALUES {tabs}), cols(ord, table_name, column_name, type, family, pk, allowed) AS (VALUES {cols}), "
        f"fks(ord, from_table, from_column, to_table, to_column) AS (VALUES {fks})"
    )
