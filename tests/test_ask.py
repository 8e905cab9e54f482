"""Questions to rows, the audit, rate limits, synthetic pairs."""

from millrace import audit
from millrace.ask import Assistant, SqlProvider, TokenBucket
from millrace.catalog import driver_catalog
from millrace.functions import ambiguity
from millrace.guard.check import check
from millrace.operators import synthetic
from millrace.sqlx.execute import Engine


def engine(spark, sf, **more):
    return Engine(spark, driver_catalog(), lambda t: spark.read.parquet(f"{sf}/{t}.parquet"), **({"all_tenants": True} | more))


def test_ask(spark, sf):
    a = Assistant(engine(spark, sf))
    got = a.ask("How many orders per nation are there?", dry=False)
    assert not got.error and got.result.row_count == 25 and "GROUP BY n_name" in got.sql and got.confidence > 0.8
    assert a.ask("What is the meaning of life?").error.startswith("ambiguous")
    assert a.ask("average of part").sql.startswith("SELECT avg(p_retailprice)")
    assert a.ask("List customers", tenant=3, dry=False).result.rows and "c_acctbal" not in a.ask("List customers", dry=False).result.rows[0]
    assert audit.outputs_asked("orders including the priority and their status, per customer") == ["priority", "status"] and audit.outputs_asked("all orders") == []


def test_refused_answers_are_retried(spark, sf):
    class Stubborn:
        def __init__(self):
            self.calls = 0

        def complete(self, parsed, catalog, error=""):
            self.calls += 1
            return "SELECT count(*) FROM orders, customer" if not error else "SELECT count(*) AS n FROM orders"

    p = Stubborn()
    got = Assistant(engine(spark, sf), p).ask("how many orders")
    assert p.calls == 2 and got.retries == 1 and not got.error


class Answers(SqlProvider):
    """Gives its answers one after the other and keeps the errors that it was told."""

    def __init__(self, *answers):
        self.answers, self.errors = list(answers), []

    def complete(self, parsed, catalog, error=""):
        self.errors.append(error)
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


def test_repairs_come_before_another_answer(spark, sf):
    p = Answers("SELECT o_orderprioritty FROM orders")
    got = Assistant(engine(spark, sf), p).ask("priorities of orders")
    assert got.sql == "SELECT o_orderpriority FROM orders" and got.autofixed and got.retries == 1 and len(p.errors) == 1 and not got.error
    assert got.confidence == round(0.95 - 0.03 - 0.05, 4)
    p = Answers("SELECT nothing_like_it FROM orders", "SELECT o_orderkey FROM orders")
    got = Assistant(engine(spark, sf), p).ask("list orders")
    assert got.sql == "SELECT o_orderkey FROM orders" and "nothing_like_it" in p.errors[1] and not got.autofixed


def test_little_confidence_and_coverage_are_asked_again_once(spark, sf):
    poor = "SELECT n_name FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_name IN (SELECT n_name FROM nation)))"
    p = Answers(poor, "SELECT n_name FROM nation")
    got = Assistant(engine(spark, sf), p).ask("average percent of nation names")  # warnings of the audit and many selects
    assert len(p.errors) >= 2 and p.errors[1]
    p = Answers("SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE o_orderkey = 5")
    got = Assistant(engine(spark, sf), p).ask("order 5 of the orders")
    assert got.sql.endswith("= 5") and got.coverage == 1.0 and "covered" in p.errors[1]
    p = Answers("SELECT o_orderkey FROM orders", "SELECT o_custkey FROM orders")
    assert Assistant(engine(spark, sf), p).ask("order 5 of the orders").sql == "SELECT o_orderkey FROM orders"


def test_tenants_and_ambiguous_terms(spark, sf):
    a = Assistant(engine(spark, sf, all_tenants=False), specs=[ambiguity.Spec("total", ("sum of orders amount", "count of lineitem rows"), ("sum",))])
    assert a.ask("List customers").error.startswith("tenant") and not a.ask("List customers", tenant=3).error
    got = a.ask("the total of each nation")
    assert got.error.startswith("ambiguous: total") and len(got.options) == 2
    assert not a.ask("the total sum of each nation").error and not a.ask("the total of orders").error
    assert a.ask("how many oders are there").sql.endswith("FROM orders")  # a misspelt table


def test_audit(spark):
    c = driver_catalog()
    see = lambda sql, q: audit.audit(spark, sql, q, c)
    assert see("SELECT count(*) FROM orders", "how many orders").penalty == 0
    assert see("SELECT count(*) FROM orders", "how many orders per customer").penalty > 0.1
    assert see("SELECT sum(o_custkey) FROM orders GROUP BY o_custkey", "orders").hard_fail
    assert see("SELECT c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'", "customers").hard_fail
    assert not see("SELECT c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'", "customers").hard_fail
    assert see("SELECT * FROM orders WHERE o_orderkey = 5", "order 5 with status 'F'").coverage == 0.5


def test_token_bucket():
    now = [0.0]
    b = TokenBucket(2.0, 10.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert b.take(10) == 0 and abs(b.take(4) - 2.0) < 1e-6 and b.take(100) > 0


def test_synthetic_pairs_pass_the_guard(spark):
    made = synthetic.generate(driver_catalog(), 60)
    assert made == synthetic.generate(driver_catalog(), 60) and len({q.lower() for q, *_ in made}) == len(made)
    for q, sql, _ in made:
        v = check(spark, sql, driver_catalog())
        assert v.passed, (sql, v.step, v.message)
