"""Gated execution: guard, analyse, run, cap."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..guard.check import Verdict, check
from ..guard.secure import COST_BYTES, Refused, SecureViews
from . import plan

MAX_ROWS = 1000


@dataclass
class Result:
    rows: list[dict] = field(default_factory=list)
    row_count: int = 0
    elapsed_ms: float = 0.0
    verdict: Verdict | None = None
    sql: str = ""


class Engine:
    """Runs read-only statements over a catalog's tables; ``load`` gives a table's DataFrame.

    ``tenant`` of a call is the tenant whose rows it may see. Calls without one may not read tenants' tables, unless the engine was
    made with ``all_tenants``. ``cost``: bytes that a statement may handle, see ``sqlx.plan.cost_bytes``.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, load: Callable[[str], DataFrame], all_tenants: bool = False, cost: int = COST_BYTES):
        self.spark, self.catalog, self.load, self.all_tenants, self.cost = spark, catalog, load, all_tenants, cost

    def dataframe(self, sql: str, tenant: int | None = None, question: str = "") -> DataFrame:
        """The complete result as a DataFrame; raises ``guard.secure.Refused`` for whatever the rules, the analyser, the cost, the
        tenant's scope or sensitive columns are against."""
        verdict = check(self.spark, sql, self.catalog, question)
        if not verdict.passed:
            raise Refused(verdict.step, verdict.message, verdict.retryable)
        return SecureViews(self.spark, self.catalog, tenant, self.load, self.all_tenants, self.cost).sql(verdict.written or sql, question)

    def verdict(self, sql: str, tenant: int | None = None, question: str = "") -> Verdict:
        """What :meth:`dataframe` would say, as a verdict; nothing runs."""
        try:
            verdict = check(self.spark, sql, self.catalog, question)
            if verdict.passed:
                SecureViews(self.spark, self.catalog, tenant, self.load, self.all_tenants, self.cost).sql(verdict.written, question)
        except Refused as e:
            return Verdict(False, e.step, e.message, retryable=e.retryable)
        return verdict

    def execute_query(self, sql: str, tenant: int | None = None, max_rows: int = MAX_ROWS, question: str = "") -> Result:
        """Rows at the API edge, capped unless the statement's own LIMIT is lower."""
        start = time.time()
        try:
            df = self.dataframe(sql, tenant, question)
        except Refused as e:
            return Result(verdict=Verdict(False, e.step, e.message, retryable=e.retryable), sql=sql)
        rows = [r.asDict() for r in df.limit(min(max_rows, MAX_ROWS)).collect()]
        return Result(rows, len(rows), 1000 * (time.time() - start), Verdict(True), sql)

    def explain_query(self, sql: str, tenant: int | None = None) -> dict:
        """The cost of a statement as it would be run (under the row cap), the optimiser's size of its result and the plan; nothing runs."""
        df = self.dataframe(sql, tenant).limit(MAX_ROWS)
        return {"cost": plan.cost_bytes(df), "bytes": plan.optimised_bytes(df), "plan": df._jdf.queryExecution().optimizedPlan().toString()}

    def health_check(self) -> bool:
        return self.spark.range(1).count() == 1
