"""Synthetic question/SQL pairs from templates over the catalog, and the orchestrated corpus build."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from . import corpus
from .joinpaths import JoinGraph

#: Templates and their weights. Fixed values.
WEIGHTS = {"list": 3, "count": 3, "group": 3, "join": 2, "filter": 2, "anti": 1}
SEED = 42


def _one(kind: str, rng: random.Random, catalog: Catalog, graph: JoinGraph) -> tuple[str, str] | None:
    names = sorted(t.name for t in catalog.tables.values() if not t.is_view)
    t = catalog[rng.choice(names)]
    columns = sorted(c.name for c in t.columns.values() if c.family != "skip" and c.name not in t.sensitive)
    c = rng.choice(columns)
    if kind == "list":
        return f"List the {c} of all {t.name} rows", f"SELECT {c} FROM {t.name}"
    if kind == "count":
        return f"How many {t.name} rows are there", f"SELECT COUNT(*) AS n FROM {t.name}"
    if kind == "group":
        return f"Count the {t.name} rows per {c}", f"SELECT {c}, COUNT(*) AS n FROM {t.name} GROUP BY {c}"
    if kind == "filter":
        listed = [(x.name, v) for x in t.columns.values() if x.allowed for v in sorted(x.allowed)]
        if not listed:
            return None
        col, value = rng.choice(listed)
        return f"Show {t.name} rows whose {col} is {value}", f"SELECT * FROM {t.name} WHERE {col} = '{value}'"
    near = sorted(graph.neighbours([t.name]))
    if not near:
        return None
    other = catalog[rng.choice(near)]
    key = graph.edges[t.name][other.name]
    on = " AND ".join(f"{key.from_table}.{a} = {key.to_table}.{b}" for a, b in zip(key.from_columns, key.to_columns, strict=True))
    if kind == "join":
        return f"Show the {c} of each {t.name} with its {other.name}", f"SELECT {t.name}.{c} FROM {t.name} JOIN {other.name} ON {on}"
    if key.to_table != t.name:
        return None
    return f"Which {t.name} rows have no {other.name}", f"SELECT {t.name}.{c} FROM {t.name} WHERE NOT EXISTS (SELECT 1 FROM {other.name} WHERE {on})"


def generate(catalog: Catalog, n: int, seed: int = SEED) -> list[tuple[str, str, str]]:
    """At most ``n`` (nl_query, sql, template), the same for the same seed; the first of equal questions (without case) stays."""
    rng, graph = random.Random(seed), JoinGraph.of(catalog)
    seen, out = set(), []
    kinds, weights = list(WEIGHTS), list(WEIGHTS.values())
    for _ in range(20 * n):
        if len(out) >= n:
            break
        kind = rng.choices(kinds, weights)[0]
        made = _one(kind, rng, catalog, graph)
        if made and made[0].lower() not in seen:
            seen.add(made[0].lower())
            out.append((*made, kind))
    return out


def pairs(spark: SparkSession, catalog: Catalog, n: int, seed: int = SEED) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(generate(catalog, n, seed))], "line_no long, nl_query string, sql string, category string")


def build(sources: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, funnel): pairs after removing repeats, leaks against ``test`` (nl_query) and what the gate refuses; and the rows left by each step."""
    first = Window.partitionBy(F.lower("nl_query")).orderBy("source", "line_no")
    once = sources.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    keyed = once.withColumn("id", F.concat_ws(":", "source", F.col("line_no").cast("string"))).withColumn("text", F.col("nl_query"))
    clean = corpus.deleak(keyed, test.select(F.xxhash64("nl_query").cast("string").alias("id"), F.col("nl_query").alias("text")))
    marked = corpus.gate(clean.withColumnRenamed("reason", "leak"))
    step = F.when(F.col("leak").isNotNull(), "leaked").when(F.col("reason").isNotNull(), "refused").otherwise("kept")
    marked = marked.withColumn("step", step)
    funnel = marked.groupBy("step").agg(F.count("*").alias("n"))
    return marked.filter("step = 'kept'").select(*sources.columns), funnel
