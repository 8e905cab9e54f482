"""The guard over a batch of statements: each line is a statement, its question and the step that must refuse it (empty: none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import audit, autofix
from ..catalog import driver_catalog
from ..guard import facts, rules
from ..guard.check import check, verdicts
from ..sources import ddl
from ..sqlx import plan
from ..sqlx.execute import Engine
from .tables import table

STATEMENTS = [
    ("SELECT c_name FROM customer", "", ""),
    ("SELECT c_name FROM (customer", "", "syntax"),
    ("", "", "syntax"),
    ("SELECT * FROM orders WHERE o_orderkey = :id", "", "placeholder"),
    ("SELECT o_totalprice::text FROM orders", "", ""),
    ("DROP TABLE orders", "", "safety"),
    ("INSERT INTO orders VALUES (1)", "", "safety"),
    ("SELECT pg_sleep(10)", "", "denied_functions"),
    ("SELECT reflect('java.lang.Math', 'abs', -1)", "", "denied_functions"),
    ("SELECT * FROM information_schema.tables", "", "system_catalogs"),
    ("SELECT * FROM parquet.`/etc/x`", "", "system_catalogs"),
    ("SELECT x.c_name FROM customer c", "", "aliases"),
    ("SELECT * FROM nowhere", "", "tables"),
    ("SELECT * FROM orders WHERE o_orderkey = 'abc'", "", "types"),
    ("SELECT * FROM orders WHERE o_orderkey = '123'", "", ""),
    ("SELECT * FROM orders WHERE o_orderstatus = 'SHIPPED'", "", "types"),
    ("SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F')", "", ""),
    ("SELECT * FROM orders, customer", "", "cartesian"),
    ("SELECT * FROM region CROSS JOIN nation", "", ""),
    ("SELECT * FROM orders JOIN customer ON o_orderkey = c_custkey", "", "join_domains"),
    ("SELECT * FROM orders JOIN customer ON o_custkey = c_custkey", "", ""),
    ("SELECT c_name, count(*) FROM customer", "", "aggregation"),
    ("SELECT c_mktsegment, c_name, count(*) FROM customer GROUP BY c_mktsegment", "", "aggregation"),
    ("SELECT c_custkey, c_name, count(*) FROM customer GROUP BY c_custkey", "", ""),
    ("SELECT avg(count(*)) FROM customer", "", "aggregation"),
    ("SELECT n_name, sum(c_acctbal) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name", "", "cardinality"),
    ("SELECT n_name, sum(l_quantity) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name", "", ""),
    ("SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1", "", "satisfiability"),
    ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1", "", ""),
    ("SELECT * FROM orders WHERE o_custkey IS NULL OR o_custkey IS NOT NULL", "", "satisfiability"),
    ("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderstatus = 'F'", "", "satisfiability"),
    ("SELECT * FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'F'", "", ""),
    ("SELECT * FROM orders JOIN customer ON true", "", "satisfiability"),
    ("SELECT * FROM orders WHERE o_orderkey IS NULL", "", "satisfiability"),
    ("SELECT * FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL", "", ""),
    ("SELECT 100.0 * sum(l_tax) / sum(l_tax) FROM lineitem", "", "satisfiability"),
    ("SELECT * FROM orders WHERE o_custkey = o_custkey", "", "tautology"),
    ("WITH t AS (SELECT o_orderkey FROM orders LIMIT 5) SELECT * FROM t", "", "nondeterminism"),
    ("WITH t AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) SELECT * FROM t", "", ""),
    ("SELECT * FROM orders LIMIT 5", "", ""),
    ("SELECT avg(n) FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) t", "", "zero_suppression"),
    ("SELECT avg(n) FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) t", "", ""),
    ("SELECT c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'", "", "left_join_filter"),
    ("SELECT c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'", "", ""),
    ("SELECT avg(o_custkey) FROM orders", "", "aggregates_of_keys"),
    ("SELECT count(*) FROM orders WHERE o_orderstatus = 'O'", "what percentage of orders is open", "question_percent"),
    ("SELECT sum(l_quantity) FROM lineitem", "what is the average quantity", "question_average"),
    ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1", "list all customers with orders", "question_list_all"),
    ("SELECT * FROM orders WHERE o_orderstatus = 'F'", "show the orders of each customer", "question_literals"),
    ("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", "customers in the building segment", ""),
    ("SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "", ""),
    ("SELECT range(1000000000000)", "", "denied_functions"),
    ("SELECT aes_decrypt(c_name, 'k') FROM customer", "", "denied_functions"),
    ("SELECT current_user() FROM nation", "", "denied_functions"),
    ("SELECT * FROM range(1000000000000)", "", "denied_functions"),
    ("SELECT upper(c_name), date_trunc('month', o_orderdate) FROM customer JOIN orders ON o_custkey = c_custkey", "", ""),
    ("SELECT c_mktsegment, count(*) AS n, rank() OVER (ORDER BY count(*)) AS r FROM customer GROUP BY c_mktsegment", "", "window_over_group"),
    ("SELECT c_mktsegment, n, rank() OVER (ORDER BY n) AS r FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment) t", "", ""),
    ("SELECT * FROM orders WHERE o_custkey = 17", "orders of customer 18", "question_ids"),
    ("SELECT * FROM orders WHERE o_custkey = 18", "orders of customer 18", ""),
    ("SELECT avg(l_shipdate - o_orderdate) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "the average time to ship", "average_duration"),
    ("SELECT avg(EXTRACT(EPOCH FROM (l_shipdate - o_orderdate))) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "the average time to ship", ""),
    ("SELECT c_name FROM customer AS order WHERE order.c_custkey = 5", "", ""),
]


def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, sql, q) for i, (sql, q, _) in enumerate(STATEMENTS)]
    return verdicts(spark, rows, driver_catalog()).select("id", "passed", "step")


def guard_analyser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only Spark's analyser and the plan's cost can tell, by the engine's verdict before anything runs."""
    engine = _engine(spark, sf_dir, cost=1 << 40)
    return spark.createDataFrame([(i, v.passed, v.step) for i, v in ((i, engine.verdict(sql)) for i, (sql, _) in enumerate(ANALYSED))], "id int, passed boolean, step string")


def _engine(spark: SparkSession, sf_dir: str, all_tenants: bool = True, cost: int = 1 << 42) -> Engine:
    return Engine(spark, driver_catalog(), lambda t: table(spark, sf_dir, t), all_tenants, cost)


#: Statements, and the step that must refuse them when they are analysed (empty: none).
ANALYSED = [
    ("SELECT c_nothing FROM customer", "columns"), ("SELECT doc_id FROM documents JOIN labels ON documents.doc_id = labels.doc_id", "columns"), ("SELECT no_such_function(c_name) FROM customer", "denied_functions"),
    ("SELECT c_name FROM customer", ""), ("SELECT k FROM (SELECT c_name FROM customer) t", "columns"), ("SELECT substring(o_orderdate) FROM orders", "analysis"),
    ("SELECT a.l_orderkey FROM lineitem a CROSS JOIN lineitem b CROSS JOIN lineitem c", "cost"), ("SELECT a.l_orderkey FROM lineitem a JOIN orders o ON a.l_orderkey = o.o_orderkey", ""),
    ("SELECT c_name FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey", "columns"), ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t", ""),
]
#: Statements over a table with a sensitive column, and what they give: its columns, or the step that refuses.
SENSITIVE = [
    ("SELECT s_nationkey FROM supplier UNION ALL SELECT s_acctbal FROM supplier", "", "sensitive"), ("SELECT s_acctbal FROM supplier UNION ALL SELECT s_nationkey FROM supplier", "", "sensitive"),
    ("SELECT s_nationkey FROM supplier INTERSECT SELECT s_acctbal FROM supplier", "", "sensitive"), ("SELECT s_name FROM supplier EXCEPT SELECT s_name FROM supplier WHERE s_acctbal > 0", "", "s_name"),
    ("SELECT s_name, s_acctbal FROM supplier", "", "s_name"), ("SELECT s_name, s_acctbal FROM supplier", "the acctbal of suppliers", "sensitive"), ("SELECT s_acctbal AS s_x, s_name FROM supplier", "", "sensitive"),
    ("SELECT to_json(struct(s.*)) AS j FROM supplier s", "", "sensitive"), ("SELECT count(s_acctbal) AS n FROM supplier", "", "n"), ("SELECT sum(s_acctbal) AS n FROM supplier", "", "sensitive"),
    ("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING max(s_acctbal) > 0", "", "s_nationkey,n"), ("SELECT n_name, (SELECT max(s_acctbal) FROM supplier) AS m FROM nation", "", "sensitive"),
    ("SELECT n_name, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS m FROM nation", "", "n_name,m"), ("WITH t AS (SELECT s_acctbal AS b FROM supplier) SELECT b + 1 AS c FROM t", "", "sensitive"),
    ("WITH t AS (SELECT * FROM supplier) SELECT * FROM t", "", "s_suppkey,s_name,s_nationkey"), ("SELECT s_name, lag(s_acctbal) OVER (ORDER BY s_name) AS l FROM supplier", "", "sensitive"),
    ("WITH RECURSIVE r(n, b) AS (SELECT 1, CAST(0.0 AS DOUBLE) UNION ALL SELECT n + 1, s_acctbal FROM r JOIN supplier ON s_suppkey = n WHERE n < 5) SELECT b FROM r", "", "sensitive"),
    ("SELECT x FROM supplier JOIN LATERAL (SELECT s_acctbal AS x) t ON true", "", "sensitive"), ("SELECT s_acctbal FROM supplier", "", "sensitive"), ("SELECT s_nationkey, s_acctbal, count(*) AS n FROM supplier GROUP BY CUBE (s_nationkey, s_acctbal)", "", "sensitive"),
]
#: Statements, the tenant (-1: none), whether all tenants are granted, and the step that must refuse (empty: none).
TENANTS = [
    ("SELECT c_name FROM customer", -1, False, "tenant"), ("SELECT c_name FROM customer", 3, False, ""), ("SELECT c_name FROM customer", -1, True, ""), ("SELECT n_name FROM nation", -1, False, ""),
    ("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)", -1, False, "tenant"), ("SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer", -1, False, "tenant"),
    ("WITH t AS (SELECT * FROM customer) SELECT count(*) AS n FROM t", -1, False, "tenant"),
]


def sensitive_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement shows of a table with a sensitive column."""
    engine, rows = _engine(spark, sf_dir), []
    for i, (sql, question, _) in enumerate(SENSITIVE):
        v = engine.verdict(sql, question=question)
        rows.append((i, v.step if not v.passed else ",".join(engine.dataframe(sql, question=question).columns)))
    return spark.createDataFrame(rows, "id int, shown string")


def tenant_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements without a tenant, with one and with a grant for all."""
    rows = [(i, _engine(spark, sf_dir, granted).verdict(sql, None if tenant < 0 else tenant).step) for i, (sql, tenant, granted, _) in enumerate(TENANTS)]
    return spark.createDataFrame(rows, "id int, step string")


def cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same joins under a limit of their tables' bytes a hundred times over: by key they pass, without one they are refused."""
    held = 100 * sum(plan.cost_bytes(table(spark, sf_dir, t)) for t in ("orders", "lineitem"))
    engine, rows = _engine(spark, sf_dir, cost=held), []
    for i, on in enumerate(("l_orderkey = o_orderkey", "l_orderkey < o_orderkey", "l_orderkey = o_orderkey AND l_quantity > 5", "l_quantity + o_totalprice > 5")):
        v = engine.verdict(f"SELECT l_partkey FROM orders JOIN lineitem ON {on}")
        rows.append((i, v.passed, v.step, engine.verdict(f"SELECT count(*) AS n FROM lineitem WHERE l_quantity > {i}").passed))
    return spark.createDataFrame(rows, "id int, passed boolean, step string, scan boolean")


def engine_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at the API's edge: under the cap, under the statement's own LIMIT, under the caller's, a refusal and an unknown column."""
    engine, rows = _engine(spark, sf_dir), []
    for i, (sql, most) in enumerate((("SELECT o_orderkey FROM orders", 1000), ("SELECT o_orderkey FROM orders LIMIT 3", 1000), ("SELECT o_orderkey FROM orders", 7), ("DROP TABLE orders", 5), ("SELECT nothing FROM orders", 5), ("SELECT n_name FROM nation", 1000))):
        r = engine.execute_query(sql, max_rows=most)
        rows.append((i, r.row_count, r.verdict.step))
    explained = engine.explain_query("SELECT o_orderkey FROM orders")
    rows.append((6, int(engine.health_check()) + int("Limit" in explained["plan"]) + int(explained["cost"] >= explained["bytes"] > 0), ""))
    return spark.createDataFrame(rows, "id int, n int, step string")


#: A small catalog with dates, a closure table and reference data, and statements over it with the step that must refuse them.
_FIXTURE = """
CREATE TABLE script_hold (id bigint PRIMARY KEY, hold_start_date date, hold_end_date date, started_at timestamptz, frozen_at timestamptz);
CREATE TABLE unit (id bigint PRIMARY KEY, unit_type varchar(20) NOT NULL, code varchar(20));
CREATE TABLE unit_closure (ancestor_id bigint REFERENCES unit (id), descendant_id bigint REFERENCES unit (id), depth int, PRIMARY KEY (ancestor_id, descendant_id));
CREATE TABLE relationship_kind (kind varchar(30) PRIMARY KEY, from_unit_type varchar(20), to_unit_type varchar(20));
CREATE TABLE relationship (id bigint PRIMARY KEY, from_unit_id bigint REFERENCES unit (id), to_unit_id bigint REFERENCES unit (id), kind varchar(30) REFERENCES relationship_kind (kind));
CREATE TABLE script (id bigint PRIMARY KEY, evaluation_status varchar(20));
CREATE TABLE script_assignment (id bigint PRIMARY KEY, script_id bigint REFERENCES script (id));
INSERT INTO relationship_kind (kind, from_unit_type, to_unit_type) VALUES ('PROGRAM_COURSE', 'PROGRAM', 'COURSE'), ('PREREQUISITE', 'COURSE', 'COURSE');
"""
FIXTURE = [
    ("SELECT AVG(EXTRACT(EPOCH FROM (hold_end_date - hold_start_date))) FROM script_hold", "date_arithmetic"), ("SELECT AVG(EXTRACT(EPOCH FROM (frozen_at - started_at))) FROM script_hold", ""),
    ("SELECT AVG(hold_end_date - hold_start_date) FROM script_hold", ""), ("SELECT u.code FROM unit u JOIN unit_closure c ON c.descendant_id = u.id WHERE c.ancestor_id = 5", "closure"),
    ("SELECT u.code FROM unit u JOIN unit_closure c ON c.descendant_id = u.id WHERE c.ancestor_id = 5 AND c.depth > 0", ""),
    ("SELECT r.id FROM relationship r JOIN unit a ON r.from_unit_id = a.id WHERE r.kind = 'PROGRAM_COURSE' AND a.unit_type = 'COURSE'", "reference_data"),
    ("SELECT r.id FROM relationship r JOIN unit a ON r.from_unit_id = a.id WHERE r.kind = 'PROGRAM_COURSE' AND a.unit_type = 'PROGRAM'", ""),
    ("SELECT s.id FROM script s JOIN script_assignment a ON a.script_id = s.id WHERE s.evaluation_status = 'NOT_ASSIGNED'", "unmet_status"),
    ("SELECT s.id FROM script s LEFT JOIN script_assignment a ON a.script_id = s.id WHERE s.evaluation_status = 'NOT_ASSIGNED'", ""),
    ("SELECT s.id FROM script s JOIN script_assignment a ON a.script_id = s.id WHERE s.evaluation_status IN ('NOT_ASSIGNED', 'ASSIGNED')", ""),
]


def guard_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that need dates, a closure table, reference data and states, over a catalog read from DDL."""
    rows = [(i, sql, "") for i, (sql, _) in enumerate(FIXTURE)]
    return verdicts(spark, rows, ddl.parse(_FIXTURE)).select("id", "passed", "step")


#: Statements, questions, and the advice that passes with them.
ADVISED = [
    ("SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey", "customers without orders", "question_negation"), ("SELECT count(*) AS n FROM orders", "orders by customer", "question_grouping,question_nouns"),
    ("SELECT avg(l_linenumber) AS a FROM lineitem", "average place of a lineitem", "average_of_ordinal"),
    ("SELECT c_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name", "number of orders per customer", "question_per_entity"),
    ("SELECT c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name", "number of orders per customer", ""),
    ("SELECT count(c_name) AS n FROM customer JOIN orders ON o_custkey = c_custkey", "how many orders did customers place", "question_entity"),
    ("SELECT count(*) AS n FROM events", "how many purchase events are there", "question_scope"), ("SELECT count(*) AS n FROM events WHERE event_type = 'purchase'", "how many purchase events are there", ""),
    ("SELECT c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'", "customers and orders of BUILDING", "left_join_literal"),
]


def guard_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory rules: which speak for each statement that passes."""
    steps, rows = [(step, rule) for step, rule, advisory in rules.RULES if advisory], []
    for i, (sql, question, _) in enumerate(ADVISED):
        v = check(spark, sql, driver_catalog(), question)
        tree = plan.parsed(spark, v.sql)
        s = rules.Statement(sql, v.sql, tree, facts.build(tree), question)
        rows.append((i, v.passed, len(v.advice), ",".join(sorted(step for step, rule in steps if rule(s, driver_catalog())))))
    return spark.createDataFrame(rows, "id int, passed boolean, n int, steps string")


#: Statements with an error, and what the repairs that make them pass give.
BROKEN = [
    ("SELECT c_nme, c_custkey FROM customer", ""), ("SELECT c_mktsegmnet, c_custkey FROM customer", "SELECT c_mktsegment, c_custkey FROM customer"), ("SELECT o_orderprioritty FROM orders", "SELECT o_orderpriority FROM orders"), ("SELECT c_mktsegmnet FROM customer", "SELECT c_mktsegment FROM customer"),
    ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment"),
    ("SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_nationkey) AS x FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name", "SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS x FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"),
    ("SELECT * FROM orders, customer", ""),
]


def statement_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first repair that makes the engine's verdict pass; empty where none does."""
    engine, rows = _engine(spark, sf_dir), []
    for i, (sql, _) in enumerate(BROKEN):
        v = engine.verdict(sql)
        fixed = next((x for x in autofix.repairs(sql, f"{v.step}: {v.message}", driver_catalog()) if engine.verdict(x).passed), "")
        rows.append((i, v.passed, fixed))
    return spark.createDataFrame(rows, "id int, passed boolean, fixed string")


#: Statements that pass the guard, questions, and the audit's warnings, penalty, coverage and failure.
AUDITED = [
    ("SELECT count(*) FROM orders", "how many orders", 0, 0.0, 1.0, False), ("SELECT count(*) FROM orders", "how many orders per customer", 2, 0.15, 1.0, False), ("SELECT max(o_totalprice) FROM orders", "the average price", 1, 0.10, 1.0, False),
    ("SELECT count(*) FROM orders", "what percentage of orders", 1, 0.08, 1.0, False), ("SELECT c_name FROM customer", "customers who never came", 1, 0.10, 1.0, False),
    ("SELECT * FROM orders WHERE o_orderkey = 5", "order 5 with status 'F'", 1, 0.10, 0.5, False), ("SELECT sum(o_custkey) FROM orders GROUP BY o_custkey", "orders", 1, 0.0, 1.0, True),
    ("SELECT c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'", "customers", 1, 0.0, 1.0, True),
    ("SELECT c_name FROM customer", "customers including their name and segment", 1, 0.08, 1.0, False), ("SELECT p_name FROM part", "regions", 1, 0.12, 1.0, False),
]


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for i, (sql, question, *_) in enumerate(AUDITED):
        a = audit.audit(spark, sql, question, driver_catalog())
        rows.append((i, len(a.warnings), a.penalty, a.coverage, a.hard_fail))
    return spark.createDataFrame(rows, "id int, warnings int, penalty double, coverage double, hard_fail boolean")


QUERIES = {
    f.__name__: f
    for f in (
        guard_verdicts, guard_analyser, sensitive_set_operations, tenant_refused, cost_gate, engine_execute, guard_fixture, guard_advice, statement_repairs, audit_findings,
    )
}

_values = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)

# Verdicts have no tables behind them that SQL could ask: each statement's is declared beside it. Where rows decide, SQL counts them.
ORACLE_SQL = {
    "guard_verdicts": f"SELECT * FROM (VALUES {_values((i, not step, step) for i, (_, _, step) in enumerate(STATEMENTS))}) AS t(id, passed, step)",
    "guard_analyser": f"SELECT * FROM (VALUES {_values((i, not step, step) for i, (_, step) in enumerate(ANALYSED))}) AS t(id, passed, step)",
    "sensitive_set_operations": f"SELECT * FROM (VALUES {_values((i, shown) for i, (_, _, shown) in enumerate(SENSITIVE))}) AS t(id, shown)",
    "tenant_refused": f"SELECT * FROM (VALUES {_values((i, step) for i, (*_, step) in enumerate(TENANTS))}) AS t(id, step)",
    "cost_gate": "SELECT * FROM (VALUES (0, true, '', true), (1, false, 'cost', true), (2, true, '', true), (3, false, 'cost', true)) AS t(id, passed, step, scan)",
    "engine_execute": """SELECT 0 AS id, least(1000, count(*)) AS n, '' AS step FROM orders UNION ALL SELECT 1, 3, '' UNION ALL SELECT 2, least(7, count(*)), '' FROM orders UNION ALL SELECT 3, 0, 'safety'
UNION ALL SELECT 4, 0, 'columns' UNION ALL SELECT 5, count(*), '' FROM nation UNION ALL SELECT 6, 3, ''""",
    "guard_fixture": f"SELECT * FROM (VALUES {_values((i, not step, step) for i, (_, step) in enumerate(FIXTURE))}) AS t(id, passed, step)",
    "guard_advice": f"SELECT * FROM (VALUES {_values((i, True, len([x for x in steps.split(',') if x]), steps) for i, (_, _, steps) in enumerate(ADVISED))}) AS t(id, passed, n, steps)",
    "statement_repairs": f"SELECT * FROM (VALUES {_values((i, False, fixed) for i, (_, fixed) in enumerate(BROKEN))}) AS t(id, passed, fixed)",
    "audit_findings": f"SELECT id, warnings, penalty::DOUBLE AS penalty, coverage::DOUBLE AS coverage, hard_fail FROM (VALUES {_values((i, *rest) for i, (_, _, *rest) in enumerate(AUDITED))}) AS t(id, warnings, penalty, coverage, hard_fail)",
}
