"""Question understanding over a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import driver_catalog
from ..functions import ambiguity
from ..functions import questions as Q
from .tables import table

QUESTIONS = [
    (1, "How many orders per customer are OPEN?"), (2, "List all suppliers without any line item"), (3, "What is the avg qty of each part brand?"),
    (4, "Compare total order amount of AFRICA versus ASIA"), (5, "Show customers named ACME_7 with status 'closed'"), (6, "Which parts cost more than 100.5 dollars by region"),
    (7, "Give the percentage of customer orders since last month"), (8, "the line item number of the largest order"),
]
TERMS = [("customer", "customer"), ("customers", "customer"), ("order", "orders"), ("orders", "orders"), ("line item", "lineitem"), ("supplier", "supplier"), ("suppliers", "supplier"), ("part", "part"), ("parts", "part"), ("region", "region"), ("item", "benchmark"), ("customer orders", "orders")]


WORDINGS = ["parts of more than #", "sizes under # please", "at least # of them, and not more than 99.5", "between # and 70", "exactly # parts", "the # largest parts", "no more than # parts"]
MISSPELT = [
    (1, "how many custmers per regoin"), (2, "the suplier of every line itm"), (3, "customer ordrs and parts"), (4, "weather of tomorrow"), (5, "suppliers of suplliers in regions"), (6, "odrer by cutsomer and supplir, part, item, regoin"),
]
GLOSSARY = [("supplier", ["vendor", "line item owner"], "a company that delivers parts"), ("region", [], "a part of the world"), ("part", None, "a thing that is sold"), ("the", [], "an article")]
ANSWERS = [
    (1, '{"sql": "SELECT 1", "confidence": 0.9}'), (2, 'Sure:\n```json\n{"sql": "SELECT 2"}\n```'), (3, 'text before {"sql": "SELECT 3"} and after'), (4, '{"sql": "SELECT \\"a\\" FROM t", "reasoning": broken'),
    (5, "```sql\nSELECT 5\n```"), (6, "SELECT 6 FROM t"), (7, "I can't help with that"), (8, '{"confidence": 1}'), (9, ""),
]
ROUTED = [
    (1, "the total of orders", ["orders"]), (2, "the total sum", []), (3, "show the total", []), (4, "the total: count the rows of lineitem", []), (5, "balance of each supplier", ["supplier"]), (6, "balance please", ["nation"]),
    (7, "orders of a day", []),
]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, question string")


def nl_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark).select("query_id", Q.expand(F.col("question")).alias("question"))


def nl_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark).select("query_id", Q.intent(F.col("question")).alias("intent"))


def nl_intent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of all user turns."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.groupBy(Q.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


def nl_entities_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.entities(_questions(spark), spark.createDataFrame(TERMS, "term string, table_name string"))
    return found.select("query_id", F.array_join("entities", ",").alias("entities"))


def nl_status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark).select("query_id", F.array_join(Q.status_codes(F.col("question"), ["OPEN", "CLOSED", "AFRICA", "ASIA"]), ",").alias("codes"))


def nl_quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return _questions(spark).select("query_id", F.array_join(Q.quantifiers(q), ",").alias("quantifiers"), Q.negative(q).alias("negative"))


def nl_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _questions(spark).select("query_id", Q.requirements(F.col("question")).alias("r"))
    return r.select("query_id", "r.aggregate", "r.grouping", F.array_join(F.transform("r.numbers", lambda x: x.cast("string")), ",").alias("numbers"), F.array_join("r.literals", ",").alias("literals"))


def nl_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that questions compare with: of every part's size in five wordings, and between two of its values."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"))
    said = F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), (F.col("p_partkey") % len(WORDINGS) + 1).cast("int"))
    asked = p.select("p_partkey", F.replace(said, F.lit("#"), F.col("s")).alias("question"))
    made = asked.select("p_partkey", F.explode(Q.comparisons(F.col("question"))).alias("c"))
    return made.select("p_partkey", "c.op", "c.value")


def fuzzy_code_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of questions against part types, by similarity of 85 or more."""
    asked = spark.createDataFrame([(1, "all medum and larg things"), (2, "the economi kind, not promoo")], "query_id int, question string")
    codes = table(spark, sf_dir, "part").select(F.lower("p_type").alias("code")).distinct()
    extra = spark.createDataFrame([("economy",), ("promo",), ("large",)], "code string")
    return Q.fuzzy_codes(asked, codes.unionByName(extra).distinct(), 75.0).select("query_id", "token", "code", F.round("score", 4).alias("score"))


def nl_entities_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables named in misspelt questions: exact terms first, then the most similar ones."""
    asked = spark.createDataFrame(MISSPELT, "query_id int, question string")
    found = Q.entities(asked, spark.createDataFrame(TERMS, "term string, table_name string"), least=82.0)
    return found.select("query_id", F.array_join("entities", ",").alias("entities"))


def glossary_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and aliases as whole words of all user turns and questions."""
    glossary = spark.createDataFrame(GLOSSARY, "term string, aliases array<string>, definition string")
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("query_id"), F.substring("text", 1, 200).alias("question"))
    return Q.glossary_expansion(_questions(spark).withColumn("query_id", F.col("query_id").cast("long")).unionByName(c), glossary)


def label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [*QUESTIONS, (9, "show the course with code CS-101 and the one called Alpha7"), (10, "number 42 of the list"), (11, "supplier named Supplier#12 far away from any code")]
    return spark.createDataFrame([(i, ",".join(Q.label_filters(q))) for i, q in asked], "query_id int, labels string")


def answers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in all the forms in which SQL is found."""
    rows = [(i, (a or {}).get("sql"), bool((a or {}).get("partial"))) for i, a in ((i, Q.parse_answer(t)) for i, t in ANSWERS)]
    return spark.createDataFrame(rows, "id int, sql string, partial boolean")


def ambiguity_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of several meanings: settled by a resolver, by the tables named, by a clear score, or asked back."""
    specs = [ambiguity.Spec("total", ("sum of orders amount", "count of lineitem rows"), ("sum", "count")), ambiguity.Spec("balance", ("customer balance", "supplier balance"))]
    rows = []
    for i, q, entities in ROUTED:
        r = ambiguity.route(q, entities, specs)
        rows.append((i, r.ambiguous, r.term, ",".join(r.chosen)))
    return spark.createDataFrame(rows, "query_id int, ambiguous boolean, term string, chosen string")


def schema_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.schema_vocabulary(driver_catalog().column_table(spark)).groupBy("word").agg(F.count("*").alias("tables"))


def error_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = spark.createDataFrame([(1, 'relation "Orders" does not exist near customer'), (2, "no table here")], "id int, message string")
    return errors.select("id", F.array_join(Q.error_tables(F.col("message"), list(driver_catalog().tables)), ",").alias("tables"))


QUERIES = {
    f.__name__: f
    for f in (
        nl_expand, nl_intent, nl_intent_conversations, nl_entities_exact, nl_entities_fuzzy, label_filters, answers_parsed, ambiguity_routing, nl_status_codes, nl_quantifiers, nl_requirements, nl_comparisons, fuzzy_code_match,
        glossary_expansion, schema_vocabulary, error_tables,
    )
}

_hits = lambda words: " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in words)
_SCORES = ", ".join(f"{_hits(w)} AS {n}" for n, w in Q.INTENTS.items())
_CASE = " ".join(f"WHEN {n} = best THEN '{n}'" for n in Q.INTENTS)
_rows = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
_vocabulary = sorted({(w, t.name) for t in driver_catalog().tables.values() for c in t.columns.values() for w in (*t.name.split("_"), *c.name.split("_")) if len(w) >= 3})

_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"

ORACLE_SQL = {
    "nl_expand": f"""SELECT query_id, replace(question, 'avg qty', 'average quantity') AS question FROM (VALUES {_rows(QUESTIONS)}) AS t(query_id, question)""",
    "nl_intent": "SELECT * FROM (VALUES (1, 'aggregation'), (2, 'lookup'), (3, 'relationship'), (4, 'comparison'), (5, 'status'), (6, 'comparison'), (7, 'temporal'), (8, 'aggregation')) AS t(query_id, intent)",
    "nl_intent_conversations": f"""SELECT CASE WHEN best = 0 THEN 'lookup' {_CASE} END AS intent, count(*) AS n FROM (
SELECT *, greatest({', '.join(Q.INTENTS)}) AS best FROM (SELECT {_SCORES} FROM conversations WHERE role = 'user')) GROUP BY 1""",
    "nl_entities_exact": "SELECT * FROM (VALUES (1, 'orders,customer'), (2, 'supplier,lineitem'), (3, 'part'), (4, 'orders'), (5, 'customer'), (6, 'part,region'), (7, 'orders'), (8, 'lineitem,orders')) AS t(query_id, entities)",
    "nl_status_codes": "SELECT * FROM (VALUES (1, 'OPEN'), (2, ''), (3, ''), (4, 'AFRICA,ASIA'), (5, 'CLOSED'), (6, ''), (7, ''), (8, '')) AS t(query_id, codes)",
    "nl_quantifiers": "SELECT * FROM (VALUES (1, '', false), (2, 'all,any', true), (3, 'all', false), (4, '', false), (5, '', false), (6, '', false), (7, '', false), (8, 'most', false)) AS t(query_id, quantifiers, negative)",
    "nl_requirements": """SELECT * FROM (VALUES (1, 'count', 'customer', '', ''), (2, NULL, NULL, '', ''), (3, NULL, NULL, '', ''), (4, 'sum', NULL, '', ''), (5, NULL, NULL, '', 'closed'),
(6, NULL, 'region', '100.5', ''), (7, 'percent', NULL, '', ''), (8, 'count', NULL, '', '')) AS t(query_id, aggregate, grouping, numbers, literals)""",
    "nl_comparisons": """WITH w AS (SELECT p_partkey, p_partkey % 7 AS k, p_size::DOUBLE AS s FROM part)
SELECT p_partkey, '>' AS op, s AS value FROM w WHERE k = 0 UNION ALL SELECT p_partkey, '<', s FROM w WHERE k = 1 UNION ALL SELECT p_partkey, '>=', s FROM w WHERE k = 2 UNION ALL SELECT p_partkey, '<=', 99.5 FROM w WHERE k = 2
UNION ALL SELECT p_partkey, '>=', s FROM w WHERE k = 3 UNION ALL SELECT p_partkey, '<=', 70 FROM w WHERE k = 3 UNION ALL SELECT p_partkey, '=', s FROM w WHERE k = 4 UNION ALL SELECT p_partkey, '<=', s FROM w WHERE k = 6""",
    "fuzzy_code_match": """WITH words(query_id, token) AS (VALUES (1, 'medum'), (1, 'larg'), (1, 'things'), (2, 'economi'), (2, 'kind'), (2, 'promoo')),
codes AS (SELECT DISTINCT lower(p_type) AS code FROM part UNION VALUES ('economy'), ('promo'), ('large')),
p AS (SELECT query_id, token, code, 100.0::DOUBLE * (1 - levenshtein(token, code) / greatest(length(token), length(code))::DOUBLE) AS score FROM words, codes)
SELECT query_id, token, code, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, token ORDER BY score DESC, code) AS n FROM p WHERE score >= 75) WHERE n = 1""",
    "nl_entities_fuzzy": f"""WITH w AS (SELECT query_id, list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM (VALUES {_rows(MISSPELT)}) AS t(query_id, question)),
g AS (SELECT query_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS term FROM w, range(1, 4) AS a(n), range(0, 40) AS b(k) WHERE k + n <= len(w)),
terms(term, table_name) AS (VALUES {_rows(TERMS)}), h AS (SELECT DISTINCT query_id, k, n FROM g JOIN terms USING (term)),
ex AS (SELECT query_id, 0 AS late, k, table_name FROM g JOIN terms USING (term) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = g.query_id AND h.n > g.n AND h.k < g.k + g.n AND g.k < h.k + h.n)),
fr AS (SELECT * FROM g WHERE n <= 2 AND length(term) >= 4 AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = g.query_id AND h.k < g.k + g.n AND g.k < h.k + h.n)),
sc AS (SELECT fr.query_id, fr.k, fr.n, t.term, {_SORTED.format('fr.term')} AS x, {_SORTED.format('t.term')} AS y FROM fr, (SELECT DISTINCT term FROM terms) t),
be AS (SELECT *, row_number() OVER (PARTITION BY query_id, k, n ORDER BY 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE DESC, term) AS r FROM sc WHERE 100 * (1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE) >= 82),
al AS (SELECT * FROM ex UNION ALL SELECT query_id, 1, k, table_name FROM be JOIN terms USING (term) WHERE r = 1),
f AS (SELECT query_id, table_name, min(late * 1000 + k) AS place FROM al GROUP BY query_id, table_name), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, table_name) AS r FROM f)
SELECT query_id, string_agg(table_name, ',' ORDER BY r) AS entities FROM o WHERE r <= 5 GROUP BY query_id""",
    "glossary_expansion": f"""WITH q AS (SELECT query_id, question FROM (VALUES {_rows(QUESTIONS)}) AS t(query_id, question) UNION ALL SELECT conv_id * 1000 + turn + 100, substr(text, 1, 200) FROM conversations WHERE role = 'user'),
n(name, definition) AS (VALUES {_rows([(x, d) for t, more, d in GLOSSARY for x in (t, *(more or []))])}),
s AS (SELECT query_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' ' AS s FROM q),
h AS (SELECT query_id, string_agg(DISTINCT definition, '; ' ORDER BY definition) AS notes FROM s JOIN n ON contains(s, ' ' || name || ' ') GROUP BY query_id)
SELECT query_id, question || coalesce(' | ' || notes, '') AS expanded FROM q LEFT JOIN h USING (query_id)""",
    "label_filters": "SELECT * FROM (VALUES (1, ''), (2, ''), (3, ''), (4, ''), (5, 'ACME_7'), (6, ''), (7, ''), (8, ''), (9, 'CS-101,Alpha7'), (10, ''), (11, 'Supplier')) AS t(query_id, labels)",
    "answers_parsed": """SELECT * FROM (VALUES (1, 'SELECT 1', false), (2, 'SELECT 2', false), (3, 'SELECT 3', false), (4, 'SELECT "a" FROM t', true), (5, 'SELECT 5', true), (6, 'SELECT 6 FROM t', true),
(7, NULL, false), (8, NULL, false), (9, NULL, false)) AS t(id, sql, partial)""",
    "ambiguity_routing": """SELECT * FROM (VALUES (1, false, '', ''), (2, false, '', ''), (3, true, 'total', ''), (4, false, '', ''), (5, false, '', ''), (6, true, 'balance', ''), (7, false, '', '')) AS t(query_id, ambiguous, term, chosen)""",
    "schema_vocabulary": f"SELECT word, count(*) AS tables FROM (VALUES {_rows(_vocabulary)}) AS t(word, table_name) GROUP BY word",
    "error_tables": "SELECT * FROM (VALUES (1, 'customer,orders'), (2, '')) AS t(id, tables)",
}
