"""Hybrid retrieval over the documents and embeddings tables, and knowledge chunks over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import driver_catalog
from ..functions import text as T
from ..operators import chunks, joinpaths
from ..operators import retrieval as R
from ..sources.staging import stage
from .tables import catalog_sql, table

#: Terms of a query: the rarest of a document's that at least two documents have.
QUERY_TERMS = 5


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 20, each searched for among all rows."""
    return _vectors(spark, sf_dir).filter(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.dense(_queries(spark, sf_dir), _vectors(spark, sf_dir), 20)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload filter applies before ranking."""
    hits = R.dense(_queries(spark, sf_dir), _vectors(spark, sf_dir), 3, F.col("label") == 1)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def dense_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted-list index against the exact search: how many queries, whether 90% of their ten neighbours are found, and whether probing all lists loses none."""
    v, q = _vectors(spark, sf_dir).select("chunk_id", "vector"), _queries(spark, sf_dir)
    centres, probes = R.ivf_fit(v)
    index = stage(R.ivf_index(v, centres).sortWithinPartitions("list"), "ivf")
    true = stage(R.dense(q, v, 10).select("query_id", "chunk_id"), "true")
    found = lambda n: R.dense_ivf(q, index, centres, n, 10).select("query_id", "chunk_id").join(true, ["query_id", "chunk_id"]).groupBy().agg(F.count("*").alias("n"))
    some, every = (found(n).select(F.col("n").alias(name)) for n, name in ((probes, "some"), (len(centres), "every")))
    sizes = true.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("all"))
    return sizes.crossJoin(some).crossJoin(every).select("queries", (F.col("some") >= 0.9 * F.col("all")).alias("enough"), (F.col("every") == F.col("all")).alias("lossless"), F.lit(probes < len(centres)).alias("fewer"))  # one row each


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _bm25(spark: SparkSession, sf_dir: str, analyser=T.tokens) -> DataFrame:
    """The stated query set: documents whose id is divisible by 20, by their rarest terms, against all documents. The inverted index is stored and read."""
    c = _chunks(spark, sf_dir)
    index = stage(R.postings(c, analyser(F.col("text"))), "postings")
    asked = stage(R.rare_terms(index, F.col("chunk_id") % 20 == 0, QUERY_TERMS), "terms")  # five for each query; read three times
    scored = R.bm25(asked, index, c.count())
    return scored.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_bm25(spark, sf_dir), 20).select("query_id", "chunk_id", "score", "rank")


def bm25_two_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of the lower-casing and the case-keeping analyser, each with its own terms."""
    both = R.best_fields([_bm25(spark, sf_dir), _bm25(spark, sf_dir, T.raw_tokens)])
    return R.top_k(both, 20).select("query_id", "chunk_id", "score", "rank")


def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over two fields and two analysers, of chunks of some types alone: events' kinds in order priorities and states stand in."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("chunk_id"), F.col("c_mktsegment").alias("text"), F.concat_ws(" ", F.lit("Segment of"), "c_name").alias("nl_question"),
        F.element_at(F.array(F.lit("TABLE"), F.lit("FEW_SHOT"), F.lit("GLOSSARY"), F.lit("STATUS")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("chunk_type"),
    )
    asked = spark.createDataFrame([(1, "which segment is BUILDING"), (2, "Segment of machinery")], "query_id int, question string")
    hits = R.search(asked, c, ("TABLE", "FEW_SHOT", "STATUS")).withColumn("score", F.round("score", 6))
    return R.top_k(hits, 5).select("query_id", "chunk_id", "score", "rank")


def postings_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of all documents without the postings of those in French: postings, occurrences and texts of each term."""
    d = table(spark, sf_dir, "documents")
    index = stage(R.postings(_chunks(spark, sf_dir), T.tokens(F.col("text"))), "postings")
    left = R.delete_postings(index, d.filter("lang = 'fr'").select(F.col("doc_id").alias("chunk_id")))
    return left.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("dl").alias("longest")).filter("df > 1")


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and lexical hits of all queries in one order."""
    dense = R.dense(_queries(spark, sf_dir), _vectors(spark, sf_dir), 20)
    lexical = R.top_k(_bm25(spark, sf_dir), 20)
    fused = R.fuse([x.select("query_id", "chunk_id", "rank") for x in (dense, lexical)])
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "position")


def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.top_k(_bm25(spark, sf_dir), 50).select("query_id", "chunk_id", "score")
    sentinel = spark.createDataFrame([(20, -1, R.SENTINEL)], "query_id long, chunk_id long, score double")
    return R.score_floor(scored.unionByName(sentinel), 0.8)


def topk_margin_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest label of each vector by the cosine of label means, if it is near and clearly nearest."""
    v = _vectors(spark, sf_dir)
    means = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    scored = v.drop("label").crossJoin(F.broadcast(centre)).select(  # one row a label
        F.col("chunk_id").alias("query_id"), F.col("label").alias("option"), F.round(T.cosine(F.col("vector"), F.col("centre")), 9).alias("score")
    )
    return R.disambiguate(scored, 0.3, 0.02).select("query_id", "option")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of each query's nearest chunks, whose types and sizes are made of their ids."""
    kinds = F.array(*[F.lit(k) for k in R.PRIORITY])
    hits = R.dense(_queries(spark, sf_dir), _vectors(spark, sf_dir), 30).select(
        "query_id", "chunk_id", F.element_at(kinds, (F.col("chunk_id") % len(R.PRIORITY) + 1).cast("int")).alias("chunk_type"), F.round("score", 6).alias("score"),
        (F.col("chunk_id") * 37 % 400 + 20).alias("tokens"), (F.col("chunk_id") % 41 == 0).alias("mandatory"),
    )
    return R.context_budget(hits, 3000)


def chunk_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.generate(spark, driver_catalog()).select("chunk_id", "chunk_type", "table_name", "text")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.generate(spark, driver_catalog()).groupBy("chunk_type").agg(F.count("*").alias("n"))


def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables one foreign key away from the entities of each question: every table by itself, and all pairs of neighbours in a row of the catalog."""
    graph, names = joinpaths.JoinGraph.of(driver_catalog()), list(driver_catalog().tables)
    asked = [[t] for t in names] + [[a, b] for a, b in zip(names, names[1:], strict=False)]
    rows = [(q, t) for q, e in enumerate(asked) for t in sorted(graph.neighbours(e))]
    return spark.createDataFrame(rows, "query_id int, table_name string")


def mandatory_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*driver_catalog().tables, "nowhere"]
    entities = spark.createDataFrame([(i % 4, t) for i, t in enumerate(names)], "query_id int, table_name string")
    found = R.mandatory(entities, chunks.generate(spark, driver_catalog()).select("chunk_id", "chunk_type", "table_name"))
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        dense_cosine_topk, dense_filtered, dense_ivf_recall, bm25_topk, bm25_two_analyzers, bm25_fields, postings_store, rrf_fuse, score_floor, topk_margin_disambiguation, context_budget,
        chunk_generation, chunk_counts, graph_expansion, mandatory_chunks,
    )
}

_DENSE = """
cos AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label,
    list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))
    / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""
_BM25 = """
{n}tok AS (SELECT doc_id, list_filter(regexp_split_to_array({text}, '{split}'), lambda t: t <> '') AS ts FROM documents),
{n}st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {n}tok),
{n}post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM {n}tok) GROUP BY ALL),
{n}df AS (SELECT term, count(*) AS df FROM {n}post GROUP BY term),
{n}q AS (SELECT query_id, term FROM (SELECT doc_id AS query_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS r
  FROM {n}post JOIN {n}df USING (term) WHERE doc_id % 20 = 0 AND df >= 2) WHERE r <= {k}),
{n}bm AS (SELECT query_id, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM {n}post JOIN {n}q USING (term) JOIN {n}df USING (term), {n}st GROUP BY query_id, doc_id)"""
_LOWER = _BM25.format(n="a", text="lower(text)", split="[^a-z0-9]+", k=QUERY_TERMS)
_RAW = _BM25.format(n="b", text="text", split="[^A-Za-z0-9_]+", k=QUERY_TERMS)
_TOP = "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM"
_FIELD = """
{n}tok AS (SELECT chunk_id, list_filter(regexp_split_to_array({text}, '{split}'), lambda t: t <> '') AS ts FROM c),
{n}st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {n}tok),
{n}post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM {n}tok) GROUP BY ALL),
{n}df AS (SELECT term, count(*) AS df FROM {n}post GROUP BY term),
{n}q AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array({ask}, '{split}'), lambda t: t <> '')) AS term FROM asked),
{n}bm AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
  FROM {n}post JOIN {n}q USING (term) JOIN {n}df USING (term), {n}st GROUP BY query_id, chunk_id)"""
_FIELDS = ",".join(
    _FIELD.format(n=f"f{i}", text=t.format(c), ask=t.format("question"), split=sp)
    for i, (c, t, sp) in enumerate([(c, t, sp) for c in ("text", "nl_question") for t, sp in (("lower({})", "[^a-z0-9]+"), ("{}", "[^A-Za-z0-9_]+"))])
)
_KINDS = ", ".join(f"'{k}'" for k in R.PRIORITY)
_TIER = " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN {i}" for i, (kinds, _) in enumerate(R.TIERS[:-1]))
_PRIO = " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.PRIORITY.items())
_SHARE = " ".join(f"WHEN {i} THEN {share}::DOUBLE" for i, (_, share) in enumerate(R.TIERS))
_OVER = "(total + tok <= free AND (CASE tier WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) + tok <= floor(share * free))"

#: The chunks of a catalog whose tables, columns and keys are given as rows.
_CHUNKS = """
lines AS (SELECT from_table AS t, 0 AS own, ord, from_table || '.' || from_column || ' = ' || to_table || '.' || to_column AS line FROM fks
  UNION ALL SELECT to_table, 1, ord, from_table || '.' || from_column || ' = ' || to_table || '.' || to_column FROM fks),
made AS (
  SELECT 'TABLE' AS chunk_type, table_name, 'Table ' || table_name || chr(10) || string_agg(column_name || ' ' || type || CASE WHEN pk THEN ' PK' ELSE '' END || CASE WHEN allowed <> '' THEN ' one of ' || allowed ELSE '' END, chr(10) ORDER BY ord) AS text
  FROM cols GROUP BY table_name
  UNION ALL SELECT 'FK_MAP', t, string_agg(line, chr(10) ORDER BY own, ord) FROM lines GROUP BY t
  UNION ALL SELECT 'STATUS', table_name, string_agg(table_name || '.' || column_name || ': ' || allowed, chr(10) ORDER BY ord) FROM cols WHERE allowed <> '' AND regexp_matches(column_name, '(status|state)$') GROUP BY table_name)"""

ORACLE_SQL = {
    "dense_cosine_topk": f"WITH {_DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_TOP} cos) WHERE rank < 20",
    "dense_filtered": f"WITH {_DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_TOP} cos WHERE label = 1) WHERE rank < 3",
    "dense_ivf_recall": "SELECT count(*) AS queries, true AS enough, true AS lossless, true AS fewer FROM embeddings WHERE vec_id % 20 = 0",
    "bm25_topk": f"WITH {_LOWER} SELECT query_id, chunk_id, score, rank FROM ({_TOP} abm) WHERE rank < 20",
    "bm25_two_analyzers": f"""WITH {_LOWER}, {_RAW}
SELECT query_id, chunk_id, score, rank FROM ({_TOP} (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM abm UNION ALL SELECT * FROM bbm) GROUP BY ALL)) WHERE rank < 20""",
    "bm25_fields": f"""WITH asked(query_id, question) AS (VALUES (1, 'which segment is BUILDING'), (2, 'Segment of machinery')),
c AS (SELECT c_custkey AS chunk_id, c_mktsegment AS text, 'Segment of ' || c_name AS nl_question FROM customer WHERE c_custkey % 4 IN (0, 3)), {_FIELDS}
SELECT query_id, chunk_id, score, rank FROM ({_TOP} (SELECT query_id, chunk_id, round(max(score), 6) AS score
  FROM (SELECT * FROM f0bm UNION ALL SELECT * FROM f1bm UNION ALL SELECT * FROM f2bm UNION ALL SELECT * FROM f3bm) GROUP BY ALL)) WHERE rank < 5""",
    "postings_store": """WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS ts FROM documents WHERE lang IS DISTINCT FROM 'fr'),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, max(dl) AS longest FROM post GROUP BY term HAVING count(*) > 1""",
    "rrf_fuse": f"""WITH {_DENSE}, {_LOWER},
lists AS (SELECT query_id, chunk_id, rank, 0 AS list FROM ({_TOP} cos) WHERE rank < 20 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM ({_TOP} abm) WHERE rank < 20),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (61 + rank)) AS score, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) - 1 AS position FROM f""",
    "score_floor": f"""WITH {_LOWER}, t AS (SELECT query_id, chunk_id, score FROM ({_TOP} abm) WHERE rank < 50)
SELECT query_id, chunk_id, score FROM t WHERE score >= 0.8 * (SELECT max(score) FROM t u WHERE u.query_id = t.query_id) UNION ALL SELECT 20, -1, 999.0""",
    "context_budget": f"""WITH RECURSIVE {_DENSE},
h AS (SELECT *, CASE kind {_PRIO} END AS prio, CASE {_TIER} ELSE {len(R.TIERS) - 1} END AS tier FROM (
  SELECT query_id, chunk_id, [{_KINDS}][(chunk_id % {len(R.PRIORITY)} + 1)::INTEGER] AS kind, round(score, 6) AS score, chunk_id * 37 % 400 + 20 AS tok, chunk_id % 41 = 0 AS must FROM ({_TOP} cos) WHERE rank < 30)),
f AS (SELECT query_id, 3000 - coalesce(sum(tok) FILTER (WHERE must), 0) AS free FROM h GROUP BY query_id),
o AS (SELECT h.*, free, CASE tier {_SHARE} END AS share, row_number() OVER (PARTITION BY query_id ORDER BY prio DESC, score DESC, chunk_id) AS n FROM h JOIN f USING (query_id) WHERE NOT must AND free > 0),
one AS (SELECT query_id, 0::BIGINT AS n, 0::BIGINT AS total, 0::BIGINT AS s0, 0::BIGINT AS s1, 0::BIGINT AS s2, 0::BIGINT AS s3, NULL::BIGINT AS chunk_id, false AS taken FROM f
  UNION ALL SELECT query_id, n, total + CASE WHEN ok THEN tok ELSE 0 END, s0 + CASE WHEN ok AND tier = 0 THEN tok ELSE 0 END, s1 + CASE WHEN ok AND tier = 1 THEN tok ELSE 0 END,
    s2 + CASE WHEN ok AND tier = 2 THEN tok ELSE 0 END, s3 + CASE WHEN ok AND tier = 3 THEN tok ELSE 0 END, chunk_id, ok
  FROM (SELECT query_id, o.n, total, s0, s1, s2, s3, tok, tier, o.chunk_id, {_OVER} AS ok FROM one JOIN o USING (query_id) WHERE o.n = one.n + 1)),
d AS (SELECT o.query_id, o.chunk_id, o.tok, o.free, row_number() OVER (PARTITION BY o.query_id ORDER BY o.n) AS m FROM one JOIN o ON o.query_id = one.query_id AND o.n = one.n WHERE NOT taken),
two AS (SELECT query_id, 0::BIGINT AS m, max(total) AS total, NULL::BIGINT AS chunk_id, false AS taken FROM one GROUP BY query_id
  UNION ALL SELECT d.query_id, d.m, total + CASE WHEN total + tok <= free THEN tok ELSE 0 END, d.chunk_id, total + tok <= free FROM two JOIN d ON d.query_id = two.query_id AND d.m = two.m + 1),
t AS (SELECT query_id, chunk_id, 0 AS g, row_number() OVER (PARTITION BY query_id ORDER BY prio DESC, score DESC, chunk_id) AS i FROM h WHERE must
  UNION ALL SELECT query_id, chunk_id, 1, n FROM one WHERE taken UNION ALL SELECT query_id, chunk_id, 2, m FROM two WHERE taken),
w AS (SELECT t.*, h.tok, h.prio, h.score, h.must OR h.kind IN ('FK_MAP', 'WORKFLOW', 'BUSINESS_RULE') AS safe, count(*) OVER (PARTITION BY t.query_id) AS c FROM t JOIN h ON h.query_id = t.query_id AND h.chunk_id = t.chunk_id),
x AS (SELECT *, count(*) FILTER (WHERE safe) OVER (PARTITION BY query_id) AS safes, row_number() OVER (PARTITION BY query_id, safe ORDER BY prio DESC, score DESC, chunk_id) AS r FROM w)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY prio < 8, CASE WHEN c > {R.MAX_CHUNKS} AND NOT safe THEN 1 ELSE 0 END, CASE WHEN c > {R.MAX_CHUNKS} AND NOT safe THEN r ELSE g * 1000 + i END) - 1 AS position, chunk_id, tok AS tokens
FROM x WHERE c <= {R.MAX_CHUNKS} OR safe OR r <= greatest(0, {R.MAX_CHUNKS} - safes)""",
    "topk_margin_disambiguation": """
WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
s AS (SELECT vec_id, c.label, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * c[i]))
  / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(c, lambda x: x * x)))), 9) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS nxt FROM s)
SELECT vec_id AS query_id, CASE WHEN score >= 0.3 AND score - coalesce(nxt, 0) >= 0.02 THEN label END AS option FROM r WHERE n = 1""",
    "chunk_generation": f"""WITH {catalog_sql()}, {_CHUNKS}
SELECT substr(sha256(concat_ws(':', table_name, chunk_type, text)), 1, 32) AS chunk_id, chunk_type, table_name, text FROM made""",
    "chunk_counts": f"WITH {catalog_sql()}, {_CHUNKS} SELECT chunk_type, count(*) AS n FROM made GROUP BY chunk_type",
    "graph_expansion": f"""WITH {catalog_sql()}, near AS (SELECT from_table AS a, to_table AS b FROM fks UNION SELECT to_table, from_table FROM fks),
asked AS (SELECT t.ord AS query_id, t.table_name FROM tabs t UNION ALL SELECT (SELECT count(*) FROM tabs) + t.ord, u.table_name FROM tabs t JOIN tabs u ON u.ord IN (t.ord, t.ord + 1) WHERE EXISTS (SELECT 1 FROM tabs v WHERE v.ord = t.ord + 1))
SELECT DISTINCT query_id, b AS table_name FROM asked JOIN near ON a = table_name""",
    "mandatory_chunks": f"""WITH {catalog_sql()}, {_CHUNKS} SELECT ord % 4 AS query_id, count(*) AS n, 999.0::DOUBLE AS score FROM made JOIN tabs USING (table_name) WHERE chunk_type IN ('TABLE', 'FK_MAP') GROUP BY 1""",
}
