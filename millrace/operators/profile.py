"""Profiling jobs that verify what the catalog declares against the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_key(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table_name, key, rows, keys, is_unique). Counted by key, so that no key's rows meet in one place."""
    per = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").cast("long").alias("rows"), F.count("*").alias("keys")).select(
        F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key"), "rows", "keys", (F.col("rows") == F.col("keys")).alias("is_unique")
    )


def orphans(child: DataFrame, parent: DataFrame, name: str, child_key: str, parent_key: str) -> DataFrame:
    """(fk, orphans): child rows whose key is set and has no parent. Keys are counted before the join."""
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    lost = keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphans")).select(F.lit(name).alias("fk"), "orphans")


def childless(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(childless, mean_inner, mean_left): how much an inner join would overstate children a parent."""
    n = child.groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    both = parent.select(F.col(parent_key).alias("k")).join(n, "k", "left")
    return both.agg(
        F.count_if(F.col("n").isNull()).alias("childless"), F.avg("n").alias("mean_inner"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_left")
    )


def outside_vocabulary(df: DataFrame, table: str, column: str, allowed: list[str]) -> DataFrame:
    """(table_name, column_name, value, n): the values that a declared vocabulary doesn't have."""
    return (
        df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value", "n")
    )


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
