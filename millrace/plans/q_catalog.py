"""Join paths, profiling, secured views: what the catalog makes possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import driver_catalog
from ..operators import joinpaths, profile
from .tables import table


def join_path_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per region: the path from region to lineitem is found, not written."""
    path = joinpaths.JoinGraph.of(driver_catalog()).path(["region", "lineitem"])[0]
    joined = joinpaths.join_tables(path, lambda t: table(spark, sf_dir, t))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("r_name").agg(revenue.alias("revenue"), F.count("*").alias("n")).orderBy("r_name")


def join_path_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wanted tables, one tree: part, customer and nation."""
    path = joinpaths.JoinGraph.of(driver_catalog()).path(["part", "customer", "nation"])[0]
    joined = joinpaths.join_tables(path, lambda t: table(spark, sf_dir, t))
    return joined.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"))


def profile_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [(t.name, list(t.primary_key)) for t in driver_catalog().tables.values() if t.primary_key]
    keys.append(("lineitem", ["l_orderkey", "l_linenumber"]))
    return profile.stack([profile.unique_key(table(spark, sf_dir, t), t, k) for t, k in keys])


def profile_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stack(
        [
            profile.orphans(table(spark, sf_dir, k.from_table), table(spark, sf_dir, k.to_table), f"{k.from_table}.{k.from_columns[0]}", k.from_columns[0], k.to_columns[0])
            for k in driver_catalog().foreign_keys
        ]
    )


def profile_zero_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.childless(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey")
    return d.select("childless", F.round("mean_inner", 6).alias("mean_inner"), F.round("mean_left", 6).alias("mean_left"))


def profile_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two to-many children of nation multiply a sum, against the sum without them."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    suppliers = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("m"))
    per = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("total"))
    return per.join(suppliers, "k").select("k", F.round("total", 2).alias("total"), F.round(F.col("total") * F.col("m"), 2).alias("fanned_out"), F.col("m").alias("factor"))


def profile_enum_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each declared vocabulary and how many lie outside it."""
    rows = []
    for t in driver_catalog().tables.values():
        for c in t.columns.values():
            if c.allowed is not None:
                data = table(spark, sf_dir, t.name)
                inside = F.col(c.name).isin(*sorted(c.allowed))
                rows.append(
                    data.groupBy(F.col(c.name).alias("v")).agg(F.count("*").alias("n")).agg(
                        F.count("*").alias("found"), F.coalesce(F.sum(F.when(~F.col("v").isin(*sorted(c.allowed)), F.col("n"))), F.lit(0)).cast("long").alias("outside")
                    ).select(F.lit(t.name).alias("table_name"), F.lit(c.name).alias("column_name"), "found", "outside")
                )
                del inside
    return profile.stack(rows)


def tenant_scoped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over customer and orders as tenant 3 sees it: every tenant relation is filtered at its leaf."""
    from ..guard.secure import SecureViews

    secure = SecureViews(spark, driver_catalog(), tenant=3, load=lambda t: table(spark, sf_dir, t))
    return secure.sql("SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")


def sensitive_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT * without the sensitive columns, which stay usable in predicates."""
    from ..guard.secure import SecureViews

    secure = SecureViews(spark, driver_catalog(), tenant=None, load=lambda t: table(spark, sf_dir, t), all_tenants=True)
    return secure.sql("SELECT * FROM supplier WHERE s_acctbal > 5000")


def schema_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by table and type family, with keys."""
    return driver_catalog().column_table(spark).groupBy("table_name").agg(
        F.count("*").alias("columns"), F.count_if("is_pk").alias("pk_columns"), F.count_if(F.col("family") == "integer").alias("integers"), F.count_if(F.col("allowed").isNotNull()).alias("vocabularies")
    )


def table_hash_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift against stored hashes, of which one was changed, one is of a dropped table and one is missing."""
    catalog = driver_catalog()
    stored = catalog.fingerprints() | {"part": "0" * 64, "dropped": "1" * 64}
    del stored["region"]
    return spark.createDataFrame(list(catalog.drift(stored).items()), "table_name string, state string")


_KEYS = [(t.name, ",".join(t.primary_key)) for t in driver_catalog().tables.values() if t.primary_key] + [("lineitem", "l_orderkey,l_linenumber")]

QUERIES = {
    f.__name__: f
    for f in (
        join_path_synth, join_path_three, profile_unique_keys, profile_fk_orphans, profile_zero_suppression, profile_fanout, profile_enum_vocab,
        tenant_scoped_view, sensitive_redaction, schema_inventory, table_hash_drift,
    )
}

ORACLE_SQL = {
    "join_path_synth": """
SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
GROUP BY r_name""",
    "join_path_three": """
SELECT n_name, p_brand, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY n_name, p_brand""",
    "profile_unique_keys": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{k}' AS key, sum(n)::BIGINT AS rows, count(*) AS keys, sum(n) = count(*) AS is_unique FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
        for t, k in _KEYS
    ),
    "profile_fk_orphans": " UNION ALL ".join(
        f"SELECT '{k.from_table}.{k.from_columns[0]}' AS fk, count(*) AS orphans FROM {k.from_table} c WHERE {k.from_columns[0]} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {k.to_table} p WHERE p.{k.to_columns[0]} = c.{k.from_columns[0]})"
        for k in driver_catalog().foreign_keys
    ),
    "profile_zero_suppression": """
SELECT count(*) FILTER (WHERE n = 0) AS childless, round(avg(n) FILTER (WHERE n > 0), 6) AS mean_inner, round(avg(n), 6) AS mean_left
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""",
    "profile_fanout": """
SELECT c_nationkey AS k, round(any_value(t), 2) AS total, round(sum(c_acctbal), 2) AS fanned_out, any_value(m) AS factor
FROM customer JOIN supplier ON s_nationkey = c_nationkey
JOIN (SELECT c_nationkey AS k, sum(c_acctbal) AS t FROM customer GROUP BY 1) x ON x.k = c_nationkey
JOIN (SELECT s_nationkey AS k2, count(*) AS m FROM supplier GROUP BY 1) y ON y.k2 = c_nationkey GROUP BY c_nationkey""",
    "profile_enum_vocab": " UNION ALL ".join(
        f"SELECT '{t.name}' AS table_name, '{c.name}' AS column_name, count(DISTINCT {c.name}) AS found, "
        f"count(*) FILTER (WHERE {c.name} NOT IN ({', '.join(repr(v) for v in sorted(c.allowed))})) AS outside FROM {t.name}"
        for t in driver_catalog().tables.values()
        for c in t.columns.values()
        if c.allowed is not None
    ),
    "tenant_scoped_view": """
SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY c_mktsegment""",
    "sensitive_redaction": "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "schema_inventory": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{t.name}', {len(t.columns)}, {len(t.primary_key)}, {sum(c.family == 'integer' for c in t.columns.values())}, {sum(c.allowed is not None for c in t.columns.values())})"
        for t in driver_catalog().tables.values()
    )
    + ") AS t(table_name, columns, pk_columns, integers, vocabularies)",
    "table_hash_drift": "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', '{'new' if t == 'region' else 'changed' if t == 'part' else 'same'}')" for t in driver_catalog().tables)
    + ", ('dropped', 'removed')) AS t(table_name, state)",
}
