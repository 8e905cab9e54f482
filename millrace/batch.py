"""Batches of questions: runs, their log, gold evaluation and comparison."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .ask import Assistant
from .guard.secure import Refused
from .operators import evaluate as E
from .sqlx.execute import Engine

RUN = "qnum long, question string, tier string, result string, error string, sql string, elapsed_ms double, confidence double, retries int, row_count long"


def run_batch(assistant: Assistant, questions: Iterable[tuple[int, str, str]], dry: bool = True) -> DataFrame:
    """One row for each (qnum, question, tier). Questions are asked one after the other: what takes time is the provider."""
    rows = []
    for qnum, question, tier in questions:
        try:
            a = assistant.ask(question, dry=dry)
            rows.append(
                (qnum, question, tier, "Error" if a.error else "Success", E.tagged(*_parts(a.error)) if a.error else None, a.sql, a.latency_ms.get("total", 0.0), a.confidence, a.retries, a.result.row_count if a.result else None)
            )
        except ConnectionError as e:
            rows.append((qnum, question, tier, "ProviderError", str(e), None, 0.0, 0.0, 0, None))
    return assistant.spark.createDataFrame(rows, RUN)


def _parts(error: str) -> tuple[str, str]:
    """(step, message) of an answer's error; without a step it is the audit's."""
    step, colon, message = error.partition(": ")
    return (step, message) if colon and re.fullmatch(r"\w+", step) else ("audit", error)


def evaluate_gold(engine: Engine, runs: list[dict], gold: dict[int, tuple[str, bool]]) -> DataFrame:
    """(qnum, tier, batch_result, exec_status, suspicious_success, ordered): both statements are run and compared.

    runs: qnum, tier, result, sql. gold: {qnum: (sql, ordered)}; a gold statement with ORDER BY is ordered too. A success whose rows are wrong is suspicious.
    """
    out = []
    for r in runs:
        if r["qnum"] not in gold:
            continue
        sql, flagged = gold[r["qnum"]]
        ordered = flagged or "order by" in sql.lower()
        made, error = _frame(engine, r["sql"])
        status = E.status(made, _frame(engine, sql)[0], ordered, error)
        out.append((r["qnum"], r["tier"], r["result"], status, r["result"] == "Success" and not status.startswith("correct"), ordered))
    return engine.spark.createDataFrame(out, "qnum long, tier string, batch_result string, exec_status string, suspicious_success boolean, ordered boolean")


def _frame(engine: Engine, sql: str | None) -> tuple[DataFrame | None, str]:
    if not sql:
        return None, ""
    try:
        return engine.dataframe(sql), ""
    except Refused as e:
        return None, e.message
    except Exception as e:  # the analyser's: the statement can't be run, which is its status
        return None, str(e).split("\n")[0]


def compare_runs(spark: SparkSession, base: DataFrame, new: DataFrame) -> dict:
    """Regressions, gains, net and verdict of two run logs."""
    return E.verdict(E.ab(base, new)).first().asDict()
