"""Prompts, synthetic pairs, the corpus build, and a model's metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import driver_catalog
from ..operators import chunks, evaluate, prompts, synthetic
from .tables import catalog_sql, table


#: Types of the chunks that stand in for a retrieval's hits, in no order of sections.
KINDS = ("FEW_SHOT", "FK_MAP", "TABLE", "GLOSSARY", "ODD", "STATUS", "BUSINESS_RULE", "AUDIT")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the chunks of their size's query, some twice; the first one keeps its place."""
    p = table(spark, sf_dir, "part").filter("p_partkey <= 400")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    once = p.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("chunk_id"), kind.alias("chunk_type"), F.col("p_brand").alias("text"), F.col("p_partkey").cast("int").alias("rank"))
    return once.unionByName(once.filter("chunk_id % 3 = 0").withColumn("rank", F.col("rank") + 1000))


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _hits(spark, sf_dir).select("query_id").distinct()
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t).alias("text")) for p, t in (("question", "how many?"), ("cheatsheet", "c"), ("join paths", "j"), ("hints", "h"), ("unknown", "u"))]))
    extras = q.select("query_id", parts.alias("e")).select("query_id", "e.part", "e.text")
    return prompts.assemble(_hits(spark, sf_dir), extras).select("query_id", F.md5("prompt").alias("digest"), F.length("prompt").alias("length"))


def conditional_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which audit, partition and index blocks user turns call for: by a word, or by the table they belong to."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    blocks = F.explode(F.array(*[F.struct(F.lit(k).alias("chunk_type"), F.lit(t).alias("table_name")) for k, t in (("AUDIT", "orders"), ("PARTITION", "part"), ("INDEX", "orders"), ("TABLE", "orders"))]))
    hits = c.select("query_id", blocks.alias("b")).select("query_id", "b.chunk_type", "b.table_name")
    own = c.filter("query_id % 3 = 0").select("query_id", F.lit("part").alias("table_name"))
    return prompts.called_for(hits, c, own).groupBy("chunk_type").agg(F.count("*").alias("n"))


def column_cheatsheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each table and the next one of the catalog, the second being the entity."""
    names = list(driver_catalog().tables)
    rows = [(i, t, False) for i, t in enumerate(names)] + [(i, t, True) for i, t in enumerate(names[1:])] + [(0, "nowhere", True)]
    return prompts.cheatsheet(spark.createDataFrame(rows, "query_id int, table_name string, first boolean"), driver_catalog().column_table(spark))


def correction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunk types come first for every table's name without its third letter."""
    c = chunks.generate(spark, driver_catalog())
    names = [(i, t[:2] + t[3:]) for i, t in enumerate(driver_catalog().tables)]
    found = prompts.correction_context(spark.createDataFrame(names, "query_id int, name string"), c.select("chunk_id", "chunk_type", "table_name"))
    own = found.join(c, "chunk_id").groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("place", "chunk_type", "table_name")).alias("first"))
    return own.select("query_id", "n", "first.chunk_type", "first.table_name")


def synthetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by template; every one must pass the guard (see tests)."""
    return synthetic.pairs(spark, driver_catalog(), 200)


def corpus_build_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and page addresses as pairs, against the benchmark: what each step of the build leaves."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    one = c.select(F.col("text").alias("nl_query"), F.lit("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey").alias("sql"), F.lit("curated").alias("source"), F.lit(None).cast("string").alias("category"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"))
    two = table(spark, sf_dir, "benchmark").select(F.col("text").alias("nl_query"), F.lit("SELECT 1").alias("sql"), F.lit("few_shot").alias("source"), F.lit(None).cast("string").alias("category"), F.col("item_id").alias("line_no"))
    test = table(spark, sf_dir, "benchmark").select(F.col("text").alias("nl_query"))
    return synthetic.build(one.unionByName(two), test)[1]


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    results = e.select(
        F.when(F.col("event_id") % 4 == 0, "SELECT 1 ").otherwise("SELECT 2").alias("generated"), F.lit("select 1").alias("gold"), (F.col("event_id") % 10 != 0).alias("parsed"),
        (F.col("event_id") % 3).cast("int").alias("unknown_names"), (F.col("event_type") != "error").alias("executed"), F.col("value").alias("elapsed_ms"),
    )
    m = evaluate.model_metrics(results)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def latency_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("total_ms"), (F.col("value") * 0.5).alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("b"))
    return evaluate.latency_residual(e, ["a", "b"]).select("event_id", F.round("unattributed", 4).alias("unattributed"))


def baseline_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = spark.createDataFrame([("syntax", 96.0), ("executes", 80.0), ("new", 1.0)], "metric string, value double")
    before = spark.createDataFrame([("syntax", 97.0), ("executes", 85.5)], "metric string, value double")
    return evaluate.baseline_regressions(now, before)


QUERIES = {
    f.__name__: f
    for f in (prompt_assembly, conditional_blocks, column_cheatsheet, correction_context, synthetic_pairs, corpus_build_funnel, model_metrics, latency_attribution, baseline_regressions)
}

_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"

ORACLE_SQL = {
    "prompt_assembly": f"""WITH h AS (SELECT p_size AS query_id, p_partkey AS r, [{', '.join(f"'{k}'" for k in KINDS)}][(p_partkey % {len(KINDS)} + 1)::INTEGER] AS kind, p_brand AS t FROM part WHERE p_partkey <= 400),
s AS (SELECT query_id, CASE kind WHEN 'TABLE' THEN 0 WHEN 'FK_MAP' THEN 1 WHEN 'BUSINESS_RULE' THEN 2 WHEN 'STATUS' THEN 3 WHEN 'AUDIT' THEN 4 WHEN 'GLOSSARY' THEN 5 WHEN 'FEW_SHOT' THEN 9 ELSE 8 END AS s, r,
  CASE kind WHEN 'TABLE' THEN 'schema' WHEN 'FK_MAP' THEN 'join map' WHEN 'BUSINESS_RULE' THEN 'rules' WHEN 'STATUS' THEN 'workflow' WHEN 'AUDIT' THEN 'conditional' WHEN 'GLOSSARY' THEN 'glossary' WHEN 'FEW_SHOT' THEN 'examples' ELSE 'additional' END AS name, t FROM h
  UNION ALL SELECT query_id, e.s, 0, e.name, e.t FROM (SELECT DISTINCT query_id FROM h), (VALUES (6, 'join paths', 'j'), (11, 'hints', 'h'), (13, 'cheatsheet', 'c'), (14, 'question', '```' || chr(10) || 'how many?' || chr(10) || '```')) AS e(s, name, t)),
p AS (SELECT query_id, string_agg('## ' || name || chr(10) || t, chr(10) || chr(10) ORDER BY s, r) AS p FROM s GROUP BY query_id)
SELECT query_id, md5(p) AS digest, length(p) AS length FROM p""",
    "conditional_blocks": """WITH q AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM conversations WHERE role = 'user'),
b AS (SELECT 'AUDIT' AS k, id FROM q WHERE list_has_any(w, ['audit', 'history', 'log', 'changed', 'change', 'who'])
  UNION ALL SELECT 'PARTITION', id FROM q WHERE id % 3 = 0 OR list_has_any(w, ['partition', 'archive', 'archived', 'old'])
  UNION ALL SELECT 'INDEX', id FROM q WHERE list_has_any(w, ['index', 'slow', 'fast', 'performance', 'search']) UNION ALL SELECT 'TABLE', id FROM q)
SELECT k AS chunk_type, count(*) AS n FROM b GROUP BY k""",
    "column_cheatsheet": f"""WITH {catalog_sql()},
l AS (SELECT table_name, table_name || ': ' || string_agg(line, '; ' ORDER BY line) AS line FROM (SELECT table_name, column_name || ' ' || upper(type) || CASE WHEN pk THEN ' PK' ELSE '' END || CASE WHEN allowed <> '' THEN ' ONE OF ' || allowed ELSE '' END AS line FROM cols) GROUP BY table_name),
w AS (SELECT ord AS query_id, table_name, 1 AS later FROM tabs UNION ALL SELECT ord - 1, table_name, 0 FROM tabs WHERE ord > 0)
SELECT query_id, string_agg(line, chr(10) ORDER BY later, table_name) AS text FROM w JOIN l USING (table_name) GROUP BY query_id""",
    "correction_context": f"""WITH {catalog_sql()}, k AS (SELECT table_name, 1 AS c FROM tabs UNION ALL SELECT DISTINCT t, 1 FROM (SELECT from_table AS t FROM fks UNION SELECT to_table FROM fks) UNION ALL SELECT DISTINCT table_name, 1 FROM cols WHERE allowed <> '' AND regexp_matches(column_name, '(status|state)$')),
m AS (SELECT a.ord AS query_id, b.table_name, 100 * (1 - levenshtein(substr(a.table_name, 1, 2) || substr(a.table_name, 4), b.table_name)::DOUBLE / greatest(length(a.table_name) - 1, length(b.table_name))) AS score FROM tabs a, tabs b),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_name) AS r FROM m WHERE score >= 60)
SELECT query_id, (sum(c) + 3)::BIGINT AS n, 'TABLE' AS chunk_type, table_name FROM o JOIN k USING (table_name) WHERE r = 1 GROUP BY query_id, table_name""",
    "corpus_build_funnel": f"""
WITH s AS (SELECT text, 'SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey' AS sql, 'curated' AS source, conv_id * 1000 + turn AS line_no FROM conversations WHERE role = 'user'
  UNION ALL SELECT text, 'SELECT 1', 'few_shot', item_id FROM benchmark),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY source, line_no) AS n FROM s) WHERE n = 1),
st AS (SELECT row_number() OVER () AS id, *, list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: t <> '')) AS w FROM o),
b AS (SELECT item_id, list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: t <> '')) AS w FROM benchmark),
x AS (SELECT id, len(w) AS n, unnest(w) AS t FROM st), y AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b),
lk AS (SELECT DISTINCT id FROM (SELECT id, item_id, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM x JOIN y ON x.t = y.t GROUP BY id, item_id) WHERE c / (na + nb - c)::DOUBLE >= 0.85)
SELECT CASE WHEN id IN (SELECT id FROM lk) THEN 'leaked' WHEN len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> '')) < 4 OR len(string_split(sql, ' ')) < 10 OR regexp_matches(lower(' ' || text || ' '), '(average|avg) (duration|time)') THEN 'refused' ELSE 'kept' END AS step, count(*) AS n
FROM st GROUP BY 1""",
    "model_metrics": """SELECT round(avg((event_id % 10 <> 0)::INTEGER), 6) AS syntax, round(avg((event_id % 3 = 0)::INTEGER), 6) AS no_hallucination, round(avg((event_type <> 'error')::INTEGER), 6) AS executes,
round(avg((event_id % 4 = 0)::INTEGER), 6) AS exact_match, round(quantile_cont(value, 0.5), 6) AS p50 FROM events""",
    "latency_attribution": "SELECT event_id, round(greatest(0, value - value * 0.5::DOUBLE - CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END), 4) AS unattributed FROM events",
    "baseline_regressions": "SELECT 'executes' AS metric, 85.5::DOUBLE AS before, 80.0::DOUBLE AS now, -5.5::DOUBLE AS delta",
}
