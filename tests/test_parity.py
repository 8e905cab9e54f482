"""Every query with an oracle, against DuckDB at the smallest scale."""

import datetime
import decimal
import math

import pytest


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def names():
    from millrace import plans

    return sorted(q for m in plans.modules() for q in m.ORACLE_SQL)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    from millrace.plans.tables import NAMES

    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_query(name, spark, sf, duck):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    r = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted((tuple(plain(row[cols.index(c)]) for c in order) for row in r.fetchall()), key=str)
    got = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert len(entry.queries()) > 100


def test_without_llm(tmp_path):
    """The entry module imports and registers the engine's queries where the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    n, ops, pipeline = out.stdout.split()[-3:]
    assert int(n) > 90 and ops == "0" and pipeline == "False", out.stderr
    (tmp_path / "millrace" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    shutil.copy(root / "corpus_pipeline.py", tmp_path)
    again = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert again.stdout.split()[-3:] == [n, "0", "False"], again.stderr
