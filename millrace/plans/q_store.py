"""Keeping the chunk store: upserts, deletes by table, few-shot retrieval, reranking, text search, embeddings."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import driver_catalog
from ..functions import embed
from ..functions import text as T
from ..operators import chunks, corpus
from ..operators import retrieval as R
from ..sources import ddl, jsonl, knowledge
from ..sources.failures import FailureStore
from ..sources.staging import shared_dir, stage
from ..sqlx.execute import Engine
from ..tools import ToolClient, ToolError, Tools, ToolServer
from .tables import postgres, table

_DDL = """
CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name varchar(40) UNIQUE, c_mktsegment varchar(10) CHECK (c_mktsegment IN ('BUILDING', 'MACHINERY')));
CREATE TABLE orders (o_orderkey bigint NOT NULL, o_custkey bigint REFERENCES customer (c_custkey), o_orderstatus char(1), PRIMARY KEY (o_orderkey));
"""

_SEARCH = """
SELECT doc_id FROM documents WHERE to_tsvector(text) @@ to_tsquery('the & with & thor')"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("text"), F.array("o_orderstatus", F.lit("orders")).alias("referenced_tables"))


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of large orders are replaced, the row of key -1 is new."""
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("chunk_id"), F.lit("changed").alias("text"), F.array(F.lit("x")).alias("referenced_tables"))
    new = spark.createDataFrame([(-1, "new", ["x"])], big.schema)
    return R.upsert(_store(spark, sf_dir), big.unionByName(new)).groupBy("text").agg(F.count("*").alias("n"))


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the chunks that refer to what changed."""
    return R.delete_referencing(_store(spark, sf_dir), ["F", "nowhere"]).groupBy("text").agg(F.count("*").alias("n"))


def few_shot_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest examples: a dense search filtered by type."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "FEW_SHOT").otherwise("TABLE").alias("chunk_type"))
    q = v.filter(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    return R.dense(q, v, 3, F.col("chunk_type") == "FEW_SHOT").select("query_id", "chunk_id", "rank")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as questions: the ten best by their rarest terms (BM25), ranked anew by the share of the question's words."""
    items = table(spark, sf_dir, "benchmark")
    chunks = items.select(F.col("item_id").alias("chunk_id"), "text")
    index = stage(R.postings(chunks, T.tokens(F.col("text"))), "postings")
    found = R.bm25(R.rare_terms(index, F.lit(True), 8, 1), index, chunks.count()).withColumn("score", F.round("score", 6))
    ranked = R.rerank_overlap(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), R.top_k(found, 10), chunks, 2)
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def knowledge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary files of both forms, of one content made of the benchmark: a record a line, and one list."""
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("term"), F.substring("text", 1, 40).alias("definition"), F.array(F.lit("benchmark")).alias("related_tables")
    )
    folder = f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}"
    items.coalesce(1).write.json(f"{folder}/lines")
    listed = items.agg(F.concat(F.lit("[\n"), F.array_join(F.transform(F.collect_list(F.struct("*")), lambda r: F.to_json(r)), ",\n"), F.lit("\n]")).alias("value"))
    listed.coalesce(1).write.text(f"{folder}/list")  # a file of a benchmark's size: a list is one record by its nature
    made = [knowledge.load(spark, f"{folder}/{form}", "GLOSSARY").withColumn("form", F.lit(form)) for form in ("lines", "list")]
    return made[0].unionByName(made[1]).groupBy("form", "chunk_type").agg(
        F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.min("text").alias("first"), F.sum(F.size("referenced_tables")).alias("refs")
    )


def ddl_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog read from DDL: its columns by family, keys and vocabularies, and orphans of its foreign key in the data."""
    c = ddl.parse(_DDL)
    rows = [(t.name, len(t.columns), len(t.primary_key), len(t.foreign_keys), sum(x.allowed is not None for x in t.columns.values()), len(t.unique_sets())) for t in c.tables.values()]
    made = spark.createDataFrame(rows, "table_name string, columns int, pk int, fks int, vocabularies int, unique_sets int")
    k = c.foreign_keys[0]
    lost = table(spark, sf_dir, k.from_table).join(table(spark, sf_dir, k.to_table).select(F.col(k.to_columns[0]).alias(k.from_columns[0])), k.from_columns[0], "left_anti")
    return made.crossJoin(F.broadcast(lost.agg(F.count("*").alias("orphans"))))  # one row


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit length of the stand-in embeddings of all benchmark items, and the words they are made of."""
    items = table(spark, sf_dir, "benchmark").select("item_id", embed.embed(F.col("text")).alias("v"), T.tokens(F.col("text")).alias("t"))
    return items.select("item_id", F.round(T.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.size("v").alias("dimensions"), F.size("t").alias("words"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, and read again beside a part of broken lines, which are left out."""
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    jsonl.write_runs(e, folder, "a")
    spark.createDataFrame([("{broken",), ("",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/run_id=a")
    return jsonl.read(spark, f"{folder}/run_id=a", "event_id long, event_type string, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def failure_store_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures logged, two corrected (one twice), an unknown one asked for, and the corrected ones exported as pairs."""
    folder = f"{shared_dir(spark)}/failures-{uuid.uuid4().hex}"
    store = FailureStore(spark, f"{folder}/store")
    names = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows
    keys = [store.log(f"how many in {n}", f"SELEC {n}", "syntax") for n in names]
    store.save_correction(keys[0], "SELECT 1")
    store.save_correction(keys[1], "SELECT 2")
    store.save_correction(keys[1], "SELECT 3")
    lost = not store.save_correction("nowhere", "SELECT 4") and store.get("nowhere") is None
    store.export(f"{folder}/out")
    return spark.read.json(f"{folder}/out").select("nl_query", "sql", "source", F.lit(store.list(corrected=False).count()).alias("open"), F.lit(lost).alias("lost"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model-free token count of all documents, by language."""
    d = table(spark, sf_dir, "documents").select("lang", T.estimated_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return d.groupBy("lang").agg(F.sum("t").alias("tokens"), F.min("t").alias("least"), F.max("t").alias("most"))


def manifest_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a build's manifest still holds: nothing changed, another configuration, another input."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own inputs; no executor reads them
        path = Path(folder, "pairs.jsonl")
        path.write_text("".join(f"{r.n_name}\n" for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()))
        m = corpus.manifest([str(path)], {"min_words": 4}, {"read": 25})
        rows = [(0, corpus.is_fresh(m, [str(path)], {"min_words": 4}), m["inputs"][str(path)], m["rows"]["read"]), (1, corpus.is_fresh(m, [str(path)], {"min_words": 5}), "", 0)]
        path.write_text("other")
        rows.append((2, corpus.is_fresh(m, [str(path)], {"min_words": 4}), "", 0))
    return spark.createDataFrame(rows, "id int, fresh boolean, digest string, n int")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools over HTTP: rows of a token's tenant, refusals without one and with a wrong one, unknown tools and wrong arguments."""
    engine = Engine(spark, driver_catalog(), lambda t: table(spark, sf_dir, t))
    sql, rows = "SELECT count(*) AS n FROM customer", []
    with ToolServer(Tools(engine), tenants={"three": 3}) as server:
        for i, (token, name, arguments) in enumerate(
            (("three", "execute_query", {"sql": sql}), ("", "execute_query", {"sql": sql}), ("four", "execute_query", {"sql": sql}), ("three", "no_such", {}), ("three", "execute_query", {"query": sql}),
             ("", "execute_query", {"sql": "SELECT count(*) AS n FROM nation"}), ("three", "execute_query", {"sql": sql, "tenant": 4}), ("", "health_check", {}))
        ):
            try:
                r = ToolClient(server.url, token).call(name, arguments)
                rows.append((i, r["rows"][0]["n"] if "rows" in r else int(r["healthy"]), ""))
            except ToolError as e:
                rows.append((i, -1, e.step or e.message.split(":")[0]))
    return spark.createDataFrame(rows, "id int, n int, refused string")


_COMMENTED = """
CREATE TABLE a_log (id bigint PRIMARY KEY);
CREATE TABLE course_history (id bigint PRIMARY KEY);
CREATE TABLE catalogue (id bigint PRIMARY KEY);
CREATE TABLE script (id bigint PRIMARY KEY, scan_status varchar, evaluation_status varchar);
CREATE TABLE hold (id bigint PRIMARY KEY, status varchar);
CREATE TABLE attempt (id bigint PRIMARY KEY, kind varchar);
CREATE TABLE marks (id bigint PRIMARY KEY);
CREATE TABLE plain (id bigint PRIMARY KEY, audit_note varchar);
CREATE TABLE moves (id bigint PRIMARY KEY, from_state varchar, to_state varchar);
COMMENT ON COLUMN hold.status IS 'goes from pending to released';
COMMENT ON COLUMN attempt.kind IS 'PRIMARY | REVIEW | REVAL';
COMMENT ON TABLE marks IS 'partitioned by exam';
COMMENT ON COLUMN plain.audit_note IS 'by hand @chunk:audit';
"""


def chunk_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names, states, comments and annotations make of a table."""
    made = chunks.generate(spark, ddl.parse(_COMMENTED)).filter("chunk_type NOT IN ('TABLE', 'FK_MAP')")
    return made.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list("chunk_type")), ",").alias("kinds"))


QUERIES = {
    f.__name__: f
    for f in (
        store_upsert, store_delete, few_shot_retrieval, rerank_overlap, embedding_norms, knowledge_files, ddl_catalog, json_lines, failure_store_cycle, token_estimates, manifest_freshness, tool_calls,
        chunk_predicates,
    )
} | {"text_search": postgres(_SEARCH)}

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"

ORACLE_SQL = {
    "store_upsert": """SELECT text, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 250000 THEN 'changed' ELSE o_orderpriority END AS text FROM orders UNION ALL SELECT 'new') GROUP BY text""",
    "store_delete": "SELECT o_orderpriority AS text, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "few_shot_retrieval": """SELECT query_id, chunk_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))
/ (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) DESC, v.vec_id) - 1 AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label % 2 = 0) WHERE rank < 3""",
    "rerank_overlap": f"""WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM i),
post AS (SELECT item_id, dl, term, count(*) AS tf FROM (SELECT item_id, len(w) AS dl, unnest(w) AS term FROM i) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT query_id, term FROM (SELECT item_id AS query_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS r FROM post JOIN df USING (term)) WHERE r <= 8),
bm AS (SELECT query_id, item_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM post JOIN q USING (term) JOIN df USING (term), st GROUP BY query_id, item_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM bm),
s AS (SELECT t.query_id, t.chunk_id, len(list_intersect(list_distinct(q.w), c.w))::DOUBLE / len(list_distinct(q.w)) AS score FROM t JOIN i q ON q.item_id = query_id JOIN i c ON c.item_id = chunk_id WHERE r <= 10)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s) WHERE rank < 2""",
    "knowledge_files": """SELECT form, 'GLOSSARY' AS chunk_type, count(*) AS n, count(DISTINCT item_id) AS ids, min('item ' || item_id || ': ' || substr(text, 1, 40)) AS first, count(*) AS refs
FROM benchmark, (VALUES ('lines'), ('list')) AS f(form) WHERE text IS NOT NULL GROUP BY form""",
    "ddl_catalog": """SELECT *, (SELECT count(*) FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans
FROM (VALUES ('customer', 3, 1, 0, 1, 2), ('orders', 3, 1, 1, 0, 1)) AS t(table_name, columns, pk, fks, vocabularies, unique_sets)""",
    "json_lines": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "failure_store_cycle": """SELECT 'how many in ' || r_name AS nl_query, CASE r_regionkey WHEN 0 THEN 'SELECT 1' ELSE 'SELECT 3' END AS sql, 'failures' AS source, (SELECT count(*) - 2 FROM region) AS open, true AS lost
FROM region WHERE r_regionkey < 2""",
    "token_estimates": """SELECT lang, sum(t)::BIGINT AS tokens, min(t) AS least, max(t) AS most FROM (SELECT lang, greatest(1, length(coalesce(text, '')) // 4) AS t FROM documents) GROUP BY lang""",
    "manifest_freshness": "SELECT 0 AS id, true AS fresh, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS digest, count(*)::INTEGER AS n FROM nation UNION ALL SELECT 1, false, '', 0 UNION ALL SELECT 2, false, '', 0",
    "tool_calls": """SELECT 0 AS id, count(*)::INTEGER AS n, '' AS refused FROM customer WHERE c_nationkey = 3 UNION ALL SELECT * FROM (VALUES (1, -1, 'tenant'), (2, -1, 'unknown token'), (3, -1, 'there is no tool no_such'),
(4, -1, 'wrong arguments'), (6, -1, 'arguments are an object, and the tenant isn''t one of them'), (7, 1, '')) AS t(id, n, refused) UNION ALL SELECT 5, count(*)::INTEGER, '' FROM nation""",
    "chunk_predicates": """SELECT * FROM (VALUES ('a_log', 'AUDIT'), ('course_history', 'AUDIT'), ('script', 'WORKFLOW'), ('hold', 'WORKFLOW'), ('attempt', 'STATUS'), ('marks', 'PARTITION'), ('plain', 'AUDIT'), ('moves', 'WORKFLOW')) AS t(table_name, kinds)""",
    "embedding_norms": f"SELECT item_id, CASE WHEN len({_WORDS.format('text')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, 384 AS dimensions, len({_WORDS.format('text')}) AS words FROM benchmark",
    "text_search": f"SELECT doc_id FROM documents WHERE list_has_all({_WORDS.format('text')}, ['the', 'with', 'thor'])",
}
