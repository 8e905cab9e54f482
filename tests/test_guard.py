"""Every rule with statements it must refuse and twins it must let pass."""

import pytest

from millrace.catalog import Catalog, Column, ForeignKey, Index, Table
from millrace.guard.check import check


def table(name, columns, keys=(), **more):
    """columns: "name type" with * for the primary key and ! for NOT NULL; keys: "column>table.column[=role]"."""
    made = {}
    for part in columns.split(","):
        n, kind = part.strip().split()
        made[n.rstrip("*!")] = Column(n.rstrip("*!"), kind, nullable=n[-1] not in "*!", primary=n.endswith("*"))
    fks = []
    for k in keys:
        left, right = k.split(">")
        target, role = (right.split("=", 1) + [""])[:2] if "=" in right else (right, "")
        t, c = target.split(".")
        fks.append(ForeignKey(name, (left,), t, (c,), role=role))
    return Table(name, made, fks, **more)


def vocab(t, **values):
    for c, v in values.items():
        t.columns[c].allowed = frozenset(v.split())
    return t


CATALOG = Catalog(
    [
        vocab(table("board", "id* bigint, course_id bigint, exam_id bigint, status! varchar, deadline date", ["course_id>academic_unit.id=unit_type=COURSE"]), status="OPEN CLOSED"),
        table("evaluation_attempt", "id* bigint, board_id bigint, script_id bigint, marks int, started_at timestamptz, frozen_at timestamptz", ["board_id>board.id"]),
        table("honorarium_summary", "id* bigint, board_id bigint, final_amount numeric", ["board_id>board.id"]),
        table("attempt_rule", "id* bigint, question_id bigint"),
        table("attempt_rule_group", "id* bigint, attempt_rule_id bigint", ["attempt_rule_id>attempt_rule.id"]),
        table("attempt_rule_group_question", "id* bigint, group_id bigint, question_id bigint", ["group_id>attempt_rule_group.id"]),
        table("enrolment", "id* bigint, student_id bigint, course_id bigint", indexes=[Index(("student_id", "course_id"), unique=True)]),
        table("script_hold", "id* bigint, hold_start_date date, hold_end_date date, is_active boolean"),
        table("academic_unit", "id* bigint, parent_id bigint, unit_type! varchar, code varchar, name varchar", ["parent_id>academic_unit.id", "unit_type>unit_type_config.unit_type"]),
        table("unit_type_config", "unit_type* varchar, display_name varchar"),
        table("faculty_cache", "id* bigint, department_id bigint, name varchar", ["department_id>academic_unit.id=unit_type=DEPARTMENT"]),
        table("academic_unit_closure", "ancestor_id* bigint, descendant_id* bigint, depth int", ["ancestor_id>academic_unit.id", "descendant_id>academic_unit.id"]),
        table(
            "relationship_type_config", "relationship_type* varchar, from_unit_type varchar, to_unit_type varchar",
            seed=[
                {"relationship_type": "PROGRAM_COURSE", "from_unit_type": "PROGRAM", "to_unit_type": "COURSE"},
                {"relationship_type": "CROSS_LISTING", "from_unit_type": "COURSE", "to_unit_type": "DEPARTMENT"},
                {"relationship_type": "PREREQUISITE", "from_unit_type": "COURSE", "to_unit_type": "COURSE"},
            ],
        ),
        table(
            "academic_unit_relationship", "id* bigint, from_unit_id bigint, to_unit_id bigint, relationship_type! varchar",
            ["from_unit_id>academic_unit.id", "to_unit_id>academic_unit.id", "relationship_type>relationship_type_config.relationship_type"],
        ),
        table("script", "id* bigint, evaluation_status varchar"),
        table("script_assignment", "id* bigint, script_id bigint", ["script_id>script.id"]),
        table("result", "id* bigint, script_id bigint, published_at timestamptz"),
        table("result_history", "id* bigint, result_id! bigint", ["result_id>result.id"]),
    ]
)

REFUSED = {
    "cardinality": [
        "SELECT b.id, SUM(h.final_amount), COUNT(e.id) FROM board b JOIN evaluation_attempt e ON e.board_id = b.id JOIN honorarium_summary h ON h.board_id = b.id GROUP BY b.id",
    ],
    "satisfiability": [
        "SELECT student_id, course_id FROM enrolment GROUP BY student_id, course_id HAVING COUNT(*) > 1",
        "SELECT id FROM board WHERE status = 'OPEN' AND status = 'CLOSED'",
        "SELECT id FROM board WHERE exam_id IS NULL OR exam_id IS NOT NULL",
        "SELECT id FROM board WHERE status IN ('OPEN', 'CLOSED')",
        "SELECT b.id FROM board b JOIN result r ON TRUE",
        "SELECT h.id FROM result_history h WHERE h.result_id IS NULL",
        "SELECT 100.0 * COUNT(e.id) / NULLIF(COUNT(e.id), 0) FROM evaluation_attempt e",
    ],
    "join_domains": [
        "SELECT * FROM faculty_cache f JOIN board b ON b.course_id = f.department_id",
        "WITH d AS (SELECT department_id AS dep FROM faculty_cache) SELECT * FROM d JOIN board b ON b.course_id = d.dep",
        "SELECT * FROM board b JOIN result r ON b.id = r.id",
    ],
    "date_arithmetic": ["SELECT AVG(EXTRACT(EPOCH FROM (hold_end_date - hold_start_date))) FROM script_hold", "SELECT EXTRACT(EPOCH FROM (COALESCE(hold_end_date, hold_start_date) - hold_start_date)) FROM script_hold"],
    "nondeterminism": [
        "WITH one AS (SELECT id FROM result LIMIT 1) SELECT * FROM result_history h JOIN one ON h.result_id = one.id",
        "SELECT * FROM result WHERE id IN (SELECT result_id FROM result_history LIMIT 3)",
        "SELECT * FROM result WHERE id = (SELECT result_id FROM result_history LIMIT 1)",
    ],
    "zero_suppression": ["SELECT AVG(n) FROM (SELECT r.id, COUNT(h.id) AS n FROM result r JOIN result_history h ON h.result_id = r.id GROUP BY r.id) t"],
    "closure": ["SELECT u.code FROM academic_unit u JOIN academic_unit_closure c ON c.descendant_id = u.id WHERE c.ancestor_id = 5"],
    "reference_data": [
        "SELECT * FROM academic_unit_relationship r JOIN academic_unit a ON r.from_unit_id = a.id WHERE r.relationship_type = 'PROGRAM_COURSE' AND a.unit_type = 'COURSE'",
    ],
    "aggregation": ["SELECT b.status, b.exam_id, COUNT(*) FROM board b GROUP BY b.status", "SELECT status, COUNT(*) FROM board", "SELECT AVG(COUNT(*)) FROM board GROUP BY status"],
    "cartesian": ["SELECT * FROM board, result", "SELECT * FROM board JOIN result"],
    "types": ["SELECT * FROM board WHERE id = 'abc'", "SELECT * FROM board WHERE status = 'HALF'", "SELECT * FROM script_hold WHERE is_active = 'maybe'", "SELECT * FROM board WHERE id IN (1, 'x')"],
    "left_join_filter": ["SELECT r.id FROM result r LEFT JOIN result_history h ON h.result_id = r.id WHERE h.id > 5"],
    "aliases": ["SELECT z.id FROM board b"],
    "tables": ["SELECT * FROM ghosts"],
    "safety": ["DELETE FROM board", "UPDATE board SET status = 'OPEN'", "CREATE TABLE x AS SELECT 1", "TRUNCATE TABLE board", "SET x = 1"],
    "denied_functions": ["SELECT pg_read_file('/etc/passwd')", "SELECT id FROM board WHERE set_config('a', 'b', false) = 'c'", "SELECT aes_decrypt(status, 'k') FROM board", "SELECT current_user()", "SELECT * FROM range(1000000000000)", "SELECT spark_catalog.default.f(1)"],
    "window_over_group": ["SELECT status, COUNT(*), RANK() OVER (ORDER BY COUNT(*)) FROM board GROUP BY status"],
    "unmet_status": ["SELECT s.id FROM script s JOIN script_assignment a ON a.script_id = s.id WHERE s.evaluation_status = 'NOT_ASSIGNED'"],
    "system_catalogs": ["SELECT * FROM pg_catalog.pg_tables", "SELECT * FROM pg_user", "SELECT * FROM json.`/tmp/x`"],
    "placeholder": ["SELECT * FROM board WHERE id = $1", "SELECT * FROM board WHERE id = :id"],
    "tautology": ["SELECT * FROM board b WHERE b.id = b.id", "SELECT e.marks - e.marks FROM evaluation_attempt e"],
    "syntax": ["SELEC 1", "SELECT (1", "   "],
}

PASSES = [
    "SELECT r.id, COUNT(q.id) FROM attempt_rule r JOIN attempt_rule_group g ON g.attempt_rule_id = r.id JOIN attempt_rule_group_question q ON q.group_id = g.id GROUP BY r.id",
    "SELECT b.id, COUNT(DISTINCT e.id), COUNT(DISTINCT h.id) FROM board b JOIN evaluation_attempt e ON e.board_id = b.id JOIN honorarium_summary h ON h.board_id = b.id GROUP BY b.id",
    "SELECT b.id, MAX(e.marks), MIN(h.final_amount) FROM board b JOIN evaluation_attempt e ON e.board_id = b.id JOIN honorarium_summary h ON h.board_id = b.id GROUP BY b.id",
    "SELECT student_id FROM enrolment GROUP BY student_id HAVING COUNT(*) > 1",
    "SELECT id FROM board WHERE status = 'OPEN' OR status = 'CLOSED'",
    "SELECT id FROM board WHERE status = 'OPEN' AND exam_id = 4",
    "SELECT b.id FROM board b JOIN (SELECT COUNT(*) AS n FROM result) t ON TRUE",
    "SELECT r.id FROM result r LEFT JOIN result_history h ON h.result_id = r.id WHERE h.result_id IS NULL",
    "SELECT 100.0 * COUNT(e.marks) / NULLIF(COUNT(e.id), 0) FROM evaluation_attempt e",
    "SELECT * FROM board b JOIN academic_unit u ON b.course_id = u.id",
    "SELECT * FROM faculty_cache f JOIN academic_unit u ON f.department_id = u.id",
    "SELECT AVG(EXTRACT(EPOCH FROM (frozen_at - started_at))) FROM evaluation_attempt",
    "SELECT AVG(hold_end_date - hold_start_date) FROM script_hold",
    "WITH one AS (SELECT id FROM result ORDER BY published_at DESC LIMIT 1) SELECT * FROM one",
    "SELECT * FROM result LIMIT 10",
    "SELECT * FROM result r WHERE EXISTS (SELECT 1 FROM result_history h WHERE h.result_id = r.id LIMIT 1)",
    "SELECT AVG(n) FROM (SELECT r.id, COUNT(h.id) AS n FROM result r LEFT JOIN result_history h ON h.result_id = r.id GROUP BY r.id) t",
    "SELECT SUM(n) FROM (SELECT r.id, COUNT(h.id) AS n FROM result r JOIN result_history h ON h.result_id = r.id GROUP BY r.id) t",
    "SELECT u.code FROM academic_unit u JOIN academic_unit_closure c ON c.descendant_id = u.id WHERE c.ancestor_id = 5 AND c.depth > 0",
    "SELECT * FROM academic_unit_closure WHERE ancestor_id = 5",
    "SELECT * FROM academic_unit_relationship r JOIN academic_unit a ON r.from_unit_id = a.id WHERE r.relationship_type = 'PROGRAM_COURSE' AND a.unit_type = 'PROGRAM'",
    "SELECT * FROM academic_unit_relationship r JOIN academic_unit a ON r.to_unit_id = a.id WHERE r.relationship_type = 'PROGRAM_COURSE' AND a.unit_type = 'COURSE'",
    "SELECT b.status, COUNT(*) FROM board b GROUP BY b.status",
    "SELECT b.id, b.status, COUNT(e.id) FROM board b LEFT JOIN evaluation_attempt e ON e.board_id = b.id GROUP BY b.id",
    "SELECT id, COUNT(*) OVER (PARTITION BY status) FROM board",
    "SELECT date_trunc('month', published_at), COUNT(*) FROM result GROUP BY 1",
    "SELECT * FROM board CROSS JOIN result",
    "SELECT * FROM board WHERE id = '123' AND status <> 'OPEN' AND exam_id = '+5'",
    "SELECT ':name' AS a, id::text FROM board -- :comment $1",
    "SELECT r.id FROM result r LEFT JOIN result_history h ON h.result_id = r.id AND h.id > 5",
    "SELECT r.id FROM result r LEFT JOIN result_history h ON h.result_id = r.id WHERE h.id IS NULL OR h.id > 5",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t",
    "SELECT id FROM board UNION SELECT id FROM result",
    "SELECT status, n, RANK() OVER (ORDER BY n) FROM (SELECT status, COUNT(*) AS n FROM board GROUP BY status) t",
    "SELECT s.id FROM script s LEFT JOIN script_assignment a ON a.script_id = s.id WHERE s.evaluation_status = 'NOT_ASSIGNED'",
    "SELECT s.id FROM script s JOIN script_assignment a ON a.script_id = s.id WHERE s.evaluation_status IN ('NOT_ASSIGNED', 'ASSIGNED')",
    "SELECT order.id FROM board AS order WHERE order.exam_id = 4", "SELECT x.id FROM result x JOIN result_history x ON x.result_id = 5 AND x.id IS NOT NULL",
    "SELECT b.id FROM board b, LATERAL (SELECT e.marks FROM evaluation_attempt e WHERE e.board_id = b.id ORDER BY e.marks LIMIT 1) x",
]


@pytest.mark.parametrize("step,sql", [(s, q) for s, qs in REFUSED.items() for q in qs])
def test_refused(spark, step, sql):
    v = check(spark, sql, CATALOG)
    assert not v.passed and v.step == step, (v.step, v.message)


@pytest.mark.parametrize("sql", PASSES)
def test_passes(spark, sql):
    v = check(spark, sql, CATALOG)
    assert v.passed, (v.step, v.message)


def test_questions(spark):
    ask = lambda sql, q: check(spark, sql, CATALOG, q)
    assert ask("SELECT COUNT(*) FROM board WHERE status = 'CLOSED'", "how many closed boards").passed
    assert ask("SELECT COUNT(*) FROM board WHERE status = 'CLOSED'", "how many boards are there").step == "question_literals"
    assert ask("SELECT MAX(marks) FROM evaluation_attempt", "the average marks").step == "question_average"
    assert ask("SELECT COUNT(*) FROM board", "what percentage is open").step == "question_percent"
    assert ask("SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY marks) FROM evaluation_attempt", "the 90th percentile of marks").passed
    assert ask("SELECT b.id FROM board b JOIN result r ON r.script_id = b.exam_id", "boards without results").advice
    assert ask("SELECT * FROM board WHERE id = 17", "board 18").step == "question_ids" and ask("SELECT * FROM board WHERE id = 18", "board 18").passed
    spent = "SELECT AVG(frozen_at - started_at) FROM evaluation_attempt"
    assert ask(spent, "the average time of an attempt").step == "average_duration" and ask(spent.replace("frozen_at - started_at", "EXTRACT(EPOCH FROM (frozen_at - started_at))"), "the average time of an attempt").passed


def test_rules_of_ones_own(spark):
    from millrace.guard import rules

    before = list(rules.RULES)
    try:
        rules.add_rule("no_board", lambda s, c: "no boards" if "board" in s.sql else None, before="types")
        assert check(spark, "SELECT id FROM board", CATALOG).step == "no_board" and check(spark, "SELECT id FROM result", CATALOG).passed
        rules.add_rule("no_board", lambda s, c: None)
        assert check(spark, "SELECT id FROM board", CATALOG).passed
        rules.remove_rule("no_board")
        assert [r[0] for r in rules.RULES] == [r[0] for r in before]
        for bad in (lambda: rules.remove_rule("safety"), lambda: rules.add_rule("x", lambda s, c: None, before="none"), lambda: rules.add_rule("", None)):
            with pytest.raises(ValueError):
                bad()
    finally:
        rules.RULES[:] = before


def test_tenants_dont_see_each_other(spark, sf):
    """Statements of several tenants at once: each sees its own rows, as each has views of its own."""
    from concurrent.futures import ThreadPoolExecutor

    from millrace.catalog import driver_catalog
    from millrace.sqlx.execute import Engine

    engine = Engine(spark, driver_catalog(), lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda t: (t, {r["c_nationkey"] for r in engine.execute_query("SELECT c_nationkey FROM customer", t).rows}), [k % 5 for k in range(20)]))
    assert all(seen <= {t} for t, seen in got) and any(seen for _, seen in got)
    assert engine.execute_query("SELECT c_name FROM customer").verdict.step == "tenant" and not spark.catalog.tableExists("customer")
    assert engine.execute_query("SELECT nothing FROM nation").verdict.step == "columns"


def test_a_renamed_or_constant_column_stays_sensitive(spark):
    """What counts is the catalog's column, wherever its values come from."""
    from pyspark.sql import functions as F

    from millrace.catalog import driver_catalog
    from millrace.guard.secure import Refused, SecureViews

    base = spark.createDataFrame([(1, "a", 3, 5.0)], "s_suppkey long, s_name string, s_nationkey int, bal double")
    for df in (base.withColumnRenamed("bal", "s_acctbal"), base.drop("bal").withColumn("s_acctbal", F.lit(7.0))):
        views = SecureViews(spark, driver_catalog(), None, lambda t, df=df: df)
        assert views.sql("SELECT * FROM supplier").columns == ["s_suppkey", "s_name", "s_nationkey"]
        for bad in ("SELECT s_acctbal AS s_x FROM supplier", "SELECT to_json(struct(*)) FROM supplier", "SELECT s_nationkey FROM supplier UNION ALL SELECT s_acctbal FROM supplier"):
            with pytest.raises(Refused):
                views.sql(bad)


def test_secured_views(spark, sf):
    from millrace.catalog import driver_catalog
    from millrace.guard.secure import Refused, SecureViews
    from millrace.sqlx.execute import Engine

    load = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    everyone, three = SecureViews(spark, driver_catalog(), None, load, all_tenants=True), SecureViews(spark, driver_catalog(), 3, load)
    # Twice in one scope, in a subquery and in a union: each reading is filtered.
    sql = "SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey <> 3)"
    assert three.sql(sql).first().n == 0 and everyone.sql(sql).first().n > 0
    assert three.sql("SELECT c_nationkey FROM customer UNION SELECT c_nationkey FROM customer").collect() in ([], [(3,)])
    with pytest.raises(Refused):
        SecureViews(spark, driver_catalog(), "3 OR 1=1", load)
    with pytest.raises(Refused):
        SecureViews(spark, driver_catalog(), None, load).sql("SELECT c_name FROM customer")
    assert everyone.sql("SELECT * FROM supplier").columns == ["s_suppkey", "s_name", "s_nationkey"]
    for bad in ("SELECT s_acctbal FROM supplier", "SELECT s_name, s_acctbal * 2 AS x FROM supplier", "WITH t AS (SELECT s_acctbal AS y FROM supplier) SELECT y + 1 AS z FROM t"):
        with pytest.raises(Refused):
            everyone.sql(bad)
    engine = Engine(spark, driver_catalog(), load)
    assert engine.execute_query("SELECT o_orderkey FROM orders", max_rows=7).row_count == 7
    assert engine.execute_query("DROP TABLE orders").verdict.step == "safety"
    assert engine.explain_query("SELECT count(*) AS n FROM orders")["bytes"] > 0 and engine.health_check()
