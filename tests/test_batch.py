"""Batch runs with gold evaluation, and the incremental knowledge store."""

from millrace import batch
from millrace.ask import Assistant, SqlProvider
from millrace.catalog import driver_catalog
from millrace.ingest import KnowledgeStore
from millrace.sqlx.execute import Engine

DDL = """
CREATE TABLE customer (id bigint PRIMARY KEY, name varchar NOT NULL);
CREATE TABLE orders (id bigint PRIMARY KEY, customer_id bigint REFERENCES customer(id), status varchar CHECK (status IN ('OPEN', 'DONE')));
CREATE TABLE audit_log (id bigint PRIMARY KEY, note text);
"""


def test_run_log_gold_and_comparison(spark, sf):
    engine = Engine(spark, driver_catalog(), lambda t: spark.read.parquet(f"{sf}/{t}.parquet"), all_tenants=True)

    class Offline(SqlProvider):
        def complete(self, parsed, catalog, error=""):
            raise ConnectionError("no network")

    asked = [(1, "How many orders are there?", "High"), (2, "What is the weather?", "Low"), (3, "count of region rows", "Low")]
    runs = batch.run_batch(Assistant(engine), asked, dry=False)
    rows = {r.qnum: r for r in runs.collect()}
    assert rows[1].result == "Success" and rows[1].row_count == 1 and rows[2].result == "Error" and rows[3].result == "Success"
    gold = {1: ("SELECT count(*) FROM orders", False), 3: ("SELECT count(*) + 1 FROM region", False), 2: ("SELECT 1", False)}
    got = {r.qnum: r for r in batch.evaluate_gold(engine, [r.asDict() for r in rows.values()], gold).collect()}
    assert got[1].exec_status == "correct" and got[3].exec_status == "wrong_rows" and got[3].suspicious_success and got[2].exec_status == "no_generated_sql"
    down = batch.run_batch(Assistant(engine, Offline()), asked)
    assert {r.result for r in down.collect()} == {"ProviderError", "Error"}
    assert rows[2].error.startswith("(semantic) ambiguous") or "ambiguous" in rows[2].error
    assert batch.compare_runs(spark, runs, down)["verdict"] == "WORSE"


def test_store_is_incremental(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path))
    first = store.ingest(DDL)
    assert first.version == 1 and set(first.drift.values()) == {"new"}
    assert store.ingest(DDL).version == 1
    before = {r.chunk_id for r in store.chunks().collect()}
    changed = store.ingest(DDL.replace("note text", "note text, level int"))
    assert changed.version == 2 and changed.drift == {"audit_log": "changed", "customer": "same", "orders": "same"}
    after = {r.chunk_id for r in store.chunks().collect()}
    assert len(before - after) == 1 and len(after - before) == 1  # the TABLE chunk; the AUDIT chunk says the same as before
    dropped = store.ingest(DDL.split("CREATE TABLE audit_log")[0])
    assert dropped.drift["audit_log"] == "removed" and not store.chunks().filter("table_name = 'audit_log'").count()
    hits = store.search("which customer has open orders", entities=["orders"])
    assert {h["table_name"] for h in hits} >= {"orders"} and hits[0]["mandatory"] and any(h["chunk_type"] == "FK_MAP" for h in hits)
