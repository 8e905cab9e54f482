"""Corpus preparation over the driver's tables: normalisation, duplicates, leaks, the quality gate, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus
from ..sources.staging import stage
from .tables import table

_Q = "Business Question → SQL"
_LONG = "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O'"
#: Pairs that each test of the gate catches, in its order, and some that pass.
PAIRS = [
    (1, "count open orders by customer", f"{_LONG} GROUP BY o_custkey", _Q), (2, "fix this query for me", f"{_LONG} GROUP BY o_custkey", "Conceptual"), (3, "what is the total", " ", ""),
    (4, "tell me about the data", "I am sorry but there is no such data in any of the tables", ""), (5, "join all the things here", "SELECT o.*, l.* FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey", ""),
    (6, "orders of one customer now", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :cust_id AND o_totalprice > 5", None), (7, "  ", f"{_LONG} GROUP BY o_custkey", ""),
    (8, "two words", f"{_LONG} GROUP BY o_custkey", ""), (9, "a very short statement here", "SELECT c_name FROM customer", ""), (10, "change every row of part", "VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)", ""),
    (11, "names with a colon in them", "SELECT ':x' AS a, b::text AS c FROM part WHERE d = 1 AND e = 2", _Q), (12, "orders since some day please", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > :start_date AND o_custkey IN (1, 2)", ""),
    (13, "orders of a status please", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 5 AND o_orderstatus = :status", ""),
    (14, "show me this very value", "SELECT :value AS v, o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 5", ""),
    (15, "the orders joined by something", "SELECT o_orderkey, c_name, c_custkey, o_totalprice FROM orders JOIN customer ON c_name = :name", ""),
    (16, "how many orders per customer", "SELECT c_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name", ""),
    (17, "how many orders per customer", "SELECT c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name", ""),
    (18, "the average duration of delivery", "SELECT avg(l_shipdate - o_orderdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey", ""),
    (19, "one very long statement of many", "SELECT " + ", ".join(["1"] * 805), ""), (20, "with a common table expression", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT n FROM t", ""),
]
_PAIR_SQL = ", ".join("({}, {})".format(i, ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in rest)) for i, *rest in PAIRS)


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "id int, nl_query string, sql string, category string")


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("n"))
    return d.select("doc_id", F.md5("n").alias("digest"), F.length("n").alias("length"))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedup_exact(table(spark, sf_dir, "documents"), F.col("text"), ["doc_id"]).select("doc_id", "lang")


def deleak_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat one of lesser id: exactly once normalised, or with Jaccard 0.85 or more; and why.

    Copies are told by a digest of their normalised text; only the first of each text is compared with others.
    """
    sets = stage(corpus.word_sets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")), "word-sets")
    again = stage(corpus.repeats(sets), "word-repeats")
    near = corpus.nearest_before(sets, again.filter("not leads").select("key", "id"))
    copies = again.filter("n > 0").select("id", F.explode(F.array_repeat(F.lit("exact"), F.col("n").cast("int"))).alias("reason"))
    said = F.pandas_udf(lambda j: j.map("jaccard={:.3f}".format), "string")  # of the double's exact value; Spark's own format rounds its shortest digits
    return copies.unionByName(near.select("id", said("jaccard").alias("reason")))


def deleak_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 85% of a benchmark item's distinct words.

    A document that does shares one of the item's rarest words (of n, the first n - ceil(0.85 n) + 1): only those are joined. Of the
    documents' words only those of items are kept, once, in a staged table.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"))
    parts = items.select("item_id", F.size("b").alias("n"), F.explode("b").alias("t"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.token_set(F.col("text"))).alias("t"))
    words = stage(docs.join(parts.select("t").distinct(), "t", "left_semi"), "item-words")  # broadcast below Spark's own threshold
    often = words.groupBy("t").agg(F.count("*").alias("df"))
    order = Window.partitionBy("item_id").orderBy("df", "t")
    listed = parts.join(often, "t", "left").fillna(0, ["df"]).withColumn("r", F.row_number().over(order))
    rare = listed.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(0.85) * F.col("n") - 1e-9) + 1)
    found = words.join(rare.select("item_id", "t"), "t").select("doc_id", "item_id").distinct()
    shared = found.join(words, "doc_id").join(parts, ["item_id", "t"]).groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("k"))
    return shared.filter(F.col("k") / F.col("n") >= 0.85).select("doc_id", "item_id")


def quality_gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.funnel(corpus.gate(_pairs(spark)))


def quality_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.gate(_pairs(spark)).select("id", F.coalesce("reason", F.lit("kept")).alias("reason"))


def scrub_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns in which every other word of four letters is made a bind, scrubbed."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    prose = F.regexp_replace("text", " ([a-z]{4}) ", " :$1 ")
    return c.select("conv_id", "turn", T.scrub_binds(F.concat(prose, F.lit(" and x::text"))).alias("prose"))


def placeholder_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pair's binds come to: literals, predicates left out, or refusal."""
    return _pairs(spark).select("id", corpus.settled_binds(F.col("sql")).alias("b")).select("id", "b.sql", "b.status")


def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt of four sections and three chunks fitted to growing budgets: what is left of it."""
    sections = [{"name": n, "tokens": t, "drop": d} for n, t, d in (("schema", 30, None), ("hints", 20, 1), ("examples", 40, 2), ("glossary", 10, 3))]
    parts = [{"text": "g" * 160, "gold": True}, {"text": "a" * 80, "gold": False}, {"text": "b" * 40, "gold": False}]
    rows = []
    for budget in range(30, 190, 10):
        fit = corpus.fit_to_budget(sections, parts, budget)
        rows.append((budget, None, None, None) if fit is None else (budget, fit["tokens"], ",".join(fit["sections"]), ",".join(f"{c['text'][0]}{len(c['text'])}" for c in fit["chunks"])))
    return spark.createDataFrame(rows, "budget int, tokens int, sections string, chunks string")


def gold_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by the number of joins in statements built for each nation."""
    n = table(spark, sf_dir, "nation")
    sql = F.concat(F.lit("SELECT 1 FROM a"), F.repeat(F.lit(" JOIN b ON a.x = b.x"), (F.col("n_nationkey") % 4).cast("int")))
    return n.select("n_nationkey", corpus.gold_confidence(sql).alias("confidence"))


def training_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.envelope(corpus.gate(_pairs(spark)).filter("reason is null"))


def sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources as pairs of one shape: conversations, benchmark, pages and documents stand in for the corpora."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    made = corpus.union_sources(
        corpus.pairs(c, "curated", "text", "role", line_no="turn"),
        corpus.pairs(table(spark, sf_dir, "benchmark"), "few_shot", "text", "text", line_no="item_id"),
        corpus.pairs(table(spark, sf_dir, "pages"), "failures", "url", "html", line_no="page_id"),
        corpus.pairs(table(spark, sf_dir, "documents"), "synthetic", "text", "lang", category="source", line_no="doc_id"),
    )
    return made.groupBy("source").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"), F.count_distinct("category").alias("categories"))


QUERIES = {
    f.__name__: f
    for f in (
        text_normalise, dedup_exact, deleak_jaccard, deleak_containment, quality_gate_funnel, quality_gate_reasons, scrub_binds,
        placeholder_substitution, budget_fit, gold_confidence, training_envelope, sources_union,
    )
}

_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
#: The gate's rules in SQL. Binds of known types are put in by their names' endings; a last AND-ed equality with another bind is left out; others refuse.
_GATE = rf"""
p AS (SELECT id, trim(coalesce(nl_query, '')) AS nl, trim(coalesce(sql, '')) AS s, coalesce(category, '') AS category FROM (VALUES {_PAIR_SQL}) AS t(id, nl_query, sql, category)),
m AS (SELECT *, regexp_replace(s, '''[^'']*''', '''''', 'g') AS bare FROM p),
u AS (SELECT *, regexp_matches(bare, '(^|[^:\w]):[A-Za-z_]') AS bound,
  CASE WHEN regexp_matches(bare, '(^|[^:\w]):[A-Za-z_]') THEN regexp_replace(regexp_replace(s, '([^:\w]):(\w*_)?(id|no|num|limit|offset|count|marks|year|attempt)s?\b', '\1{corpus.INTEGER}', 'g'), '([^:\w]):(\w*date\w*|\w+_at|\w+_on)\b', '\1{corpus.DATE.replace("'", "''")}', 'g') ELSE s END AS put FROM m),
v AS (SELECT *, CASE WHEN bound THEN regexp_replace(put, ' AND \w+ = :\w+$', '') ELSE put END AS x FROM u),
w AS (SELECT *, bound AND regexp_matches(regexp_replace(x, '''[^'']*''', '''''', 'g'), '[^:\w]:[A-Za-z_]') AS open FROM v),
g AS (SELECT *, CASE WHEN NOT bound THEN 'clean' WHEN open THEN 'reject:bind' WHEN x = put THEN 'substituted' ELSE 'stripped' END AS status FROM w),
r AS (SELECT *, CASE WHEN category NOT IN ('', '{_Q}') THEN 'off_task_category' WHEN s = '' THEN 'empty_sql' WHEN NOT regexp_matches(lower(s), '^(select|with)') THEN 'prose_no_sql'
  WHEN regexp_matches(s, '(?i)SELECT\s+\w+\.\*\s*,\s*\w+\.\*') THEN 'garbage_join' WHEN open THEN 'reject:bind' WHEN nl = '' THEN 'empty_nl' WHEN len(string_split_regex(nl, '\s+')) < 4 THEN 'short_nl'
  WHEN len(string_split_regex(x, '\s+')) < 10 THEN 'short_sql' WHEN len(string_split_regex(x, '\s+')) > 800 THEN 'long_sql'
  WHEN contains(' ' || lower(nl) || ' ', ' per ') AND regexp_matches(lower(x), '\b(count|sum|avg|min|max)\s*\(') AND regexp_matches(lower(x), '\bjoin\b') AND NOT regexp_matches(lower(x), '(left|right|full)\s+(outer\s+)?join') THEN 'semantic_contract'
  WHEN regexp_matches(lower(nl), '(average|avg) (duration|time)') AND NOT contains(lower(x), 'extract(epoch') THEN 'semantic_contract' ELSE 'kept' END AS reason FROM g)"""
_FIT = """(30, NULL, NULL, NULL), (40, 40, 'schema', 'g40'), (50, 50, 'schema', 'g80'), (60, 50, 'schema', 'g80'), (70, 70, 'schema', 'g160'), (80, 70, 'schema', 'g160'), (90, 90, 'schema', 'g160,a80'), (100, 100, 'schema', 'g160,a80,b40'),
(110, 110, 'schema,glossary', 'g160,a80,b40'), (120, 110, 'schema,glossary', 'g160,a80,b40'), (130, 110, 'schema,glossary', 'g160,a80,b40'), (140, 110, 'schema,glossary', 'g160,a80,b40'), (150, 150, 'schema,examples,glossary', 'g160,a80,b40'),
(160, 150, 'schema,examples,glossary', 'g160,a80,b40'), (170, 170, 'schema,hints,examples,glossary', 'g160,a80,b40'), (180, 170, 'schema,hints,examples,glossary', 'g160,a80,b40')"""
_SETS = f"sets AS (SELECT doc_id AS id, {_NORM} AS norm, list_distinct(list_filter(string_split({_NORM}, ' '), lambda t: t <> '')) AS s FROM documents)"

ORACLE_SQL = {
    "text_normalise": f"SELECT doc_id, md5(n) AS digest, length(n) AS length FROM (SELECT doc_id, {_NORM} AS n FROM documents)",
    "dedup_exact": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "deleak_jaccard": f"""WITH {_SETS},
o AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY id) AS k FROM sets),
w AS (SELECT id, len(s) AS n, unnest(s) AS t FROM o WHERE k = 1),
p AS (SELECT a.id, b.id AS other, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM w a JOIN w b ON a.t = b.t AND a.id > b.id WHERE least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 GROUP BY a.id, b.id),
j AS (SELECT id, max(shared / (na + nb - shared)::DOUBLE) AS j FROM p GROUP BY id)
SELECT id, printf('jaccard=%.3f', j) AS reason FROM j WHERE j >= 0.85 UNION ALL SELECT id, 'exact' FROM o WHERE k > 1""",
    "deleak_containment": f"""WITH {_SETS.replace('documents', 'documents')},
b AS (SELECT item_id, list_distinct(list_filter(string_split({_NORM}, ' '), lambda t: t <> '')) AS s FROM benchmark),
bw AS (SELECT item_id, len(s) AS n, unnest(s) AS t FROM b), dw AS (SELECT id, unnest(s) AS t FROM sets)
SELECT id AS doc_id, item_id FROM bw JOIN dw USING (t) GROUP BY id, item_id, n HAVING count(*)::DOUBLE / n >= 0.85""",
    "quality_gate_funnel": f"WITH {_GATE} SELECT reason, count(*) AS n FROM r GROUP BY reason",
    "quality_gate_reasons": f"WITH {_GATE} SELECT id, reason FROM r",
    "scrub_binds": "SELECT conv_id, turn, regexp_replace(text, ' [a-z]{4} ', ' a literal value ', 'g') || ' and x::text' AS prose FROM conversations WHERE role = 'user'",
    "placeholder_substitution": f"WITH {_GATE.replace('trim(coalesce(sql', '(coalesce(sql')} SELECT id, CASE WHEN status = 'reject:bind' THEN s ELSE x END AS sql, status FROM r",
    "budget_fit": f"SELECT * FROM (VALUES {_FIT}) AS t(budget, tokens, sections, chunks)",
    "gold_confidence": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <= 1 THEN 0.92 WHEN n_nationkey % 4 = 2 THEN 0.88 ELSE 0.82 END::DOUBLE AS confidence FROM nation",
    "training_envelope": rf"""WITH {_GATE}
SELECT nl AS nl_query, '{{"sql":' || to_json(x)::VARCHAR || ',"tables_used":[' || list_aggregate(list_transform(list_sort(list_distinct(regexp_extract_all(lower(x), '\b(from|join)\s+([a-z_][\w.]*)', 2))), lambda t: '"' || t || '"'), 'string_agg', ',')
  || '],"confidence":' || CASE WHEN len(regexp_extract_all(lower(x), '\bjoin\b')) <= 1 THEN '0.92' WHEN len(regexp_extract_all(lower(x), '\bjoin\b')) = 2 THEN '0.88' ELSE '0.82' END || '}}' AS answer FROM r WHERE reason = 'kept'""",
    "sources_union": """
SELECT 'curated' AS source, count(*) AS n, sum(turn)::BIGINT AS lines, 0 AS categories FROM conversations WHERE role = 'user'
UNION ALL SELECT 'few_shot', count(*), sum(item_id)::BIGINT, 0 FROM benchmark UNION ALL SELECT 'failures', count(*), sum(page_id)::BIGINT, 0 FROM pages
UNION ALL SELECT 'synthetic', count(*), sum(doc_id)::BIGINT, count(DISTINCT source) FROM documents""",
}
