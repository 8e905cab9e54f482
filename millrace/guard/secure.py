"""Tenant scope and redaction by secured views.

Instead of adding predicates to a statement's text, every tenant relation is replaced at its leaf
by a filtered view, so no scope of a query can miss it; sensitive columns that a result would show
are dropped from it, or refuse the statement where they stand inside an expression, under another name or in a set operation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..sqlx import plan
from ..sqlx.translate import translate

#: About how many bytes a statement may handle, see ``sqlx.plan.cost_bytes``.
COST_BYTES = 1 << 42


class Refused(Exception):
    """A statement that may not run; ``step`` names the rule."""

    def __init__(self, step: str, message: str, retryable: bool = True):
        super().__init__(message)
        self.step, self.message, self.retryable = step, message, retryable


def analyser_step(error: str) -> str:
    """The step that an analysis error belongs to."""
    for word, step in (
        ("UNRESOLVED_COLUMN", "columns"), ("AMBIGUOUS_REFERENCE", "columns"), ("TABLE_OR_VIEW_NOT_FOUND", "tables"), ("AGGREG", "aggregation"), ("GROUP_BY", "aggregation"),
        ("UNRESOLVED_ROUTINE", "functions"), ("DATATYPE_MISMATCH", "types"),
    ):
        if word in error:
            return step
    return "analysis"


class SecureViews:
    """Runs statements over the catalog's tables as one tenant, an integer. Without one, a statement that reads a tenant's table is
    refused, unless ``all_tenants`` is granted. Each statement has a session of its own, so that none sees another's views."""

    def __init__(
        self, spark: SparkSession, catalog: Catalog, tenant: int | None, load: Callable[[str], DataFrame], all_tenants: bool = False, cost: int = COST_BYTES
    ):
        if tenant is not None and (isinstance(tenant, bool) or not isinstance(tenant, int)):
            raise Refused("tenant", "the tenant id must be an integer", retryable=False)
        self.spark, self.catalog, self.tenant, self.load, self.all_tenants, self.cost = spark, catalog, tenant, load, all_tenants, cost

    def relation(self, name: str) -> DataFrame:
        """A table with the tenant's rows alone, its sensitive columns marked."""
        table, df = self.catalog[name], self.load(name)
        if table.tenant_column:
            if self.tenant is not None:
                df = df.filter(F.col(f"`{table.tenant_column}`") == self.tenant)
            elif not self.all_tenants:
                raise Refused("tenant", f"{name} holds rows of several tenants: a tenant, or a grant for all of them, is required", retryable=False)
        columns, marked = df.columns, {c: f"{plan.SECRET}{name}.{c}" for c in table.sensitive}
        inner = df.select(*[F.col(f"`{c}`").alias(marked.get(c, c)) for c in columns])
        return inner.select(*[F.col(f"`{marked.get(c, c)}`").alias(c) for c in columns])

    def analysed(self, statement: str) -> DataFrame:
        """The statement over the secured relations, not yet redacted; what the analyser finds or costs too much is refused."""
        sql = translate(statement, self.catalog.integers())
        session = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        rows = self.spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
        for name in sorted(plan.relations(session, sql) & set(self.catalog.tables)):
            secured = self.relation(name)._jdf.queryExecution().analyzed()
            rows.ofRows(session._jsparkSession, secured).createOrReplaceTempView(name)
        try:
            df = session.sql(sql)
        except AnalysisException as e:
            raise Refused(analyser_step(str(e)), str(e).split("\n")[0][:300]) from e
        if (cost := plan.cost_bytes(df)) > self.cost:
            raise Refused("cost", f"about {cost:,} bytes to handle, over {self.cost:,}: filter or join by keys")
        return df

    def sql(self, statement: str, asked: str = "") -> DataFrame:
        """The statement's result without sensitive columns."""
        df = self.analysed(statement)
        if not any(t.sensitive for t in self.catalog.tables.values()):
            return df
        found = plan.secret_outputs(df)
        if found is None:
            raise Refused("sensitive", "it can't be told whether a sensitive column would be shown", retryable=False)
        shown, hidden = ([df.columns[k] for k in places] for places in found)
        if hidden:
            raise Refused("sensitive", f"{', '.join(sorted(set(hidden)))} would show a sensitive column", retryable=False)
        words = asked.lower()
        if any(w and (w in words or w.rstrip("s") in words.split()) for c in shown for w in (c.lower(), c.lower().split("_", 1)[-1])):
            raise Refused("sensitive", f"{', '.join(shown)} may not be shown", retryable=False)
        if shown and len(shown) == len(df.columns):
            raise Refused("sensitive", "only sensitive columns are left", retryable=False)
        return df.select(*[df[c] for c in _distinct(df.columns, found[0])]) if shown else df


def _distinct(columns: list[str], without: list[int]) -> list[str]:
    """The names besides those at the places ``without``; a name that occurs twice there can't be told apart and is refused."""
    kept = [c for k, c in enumerate(columns) if k not in without]
    if set(kept) & {columns[k] for k in without} or len(set(kept)) != len(kept):
        raise Refused("sensitive", "columns of one name, some of them sensitive, can't be told apart", retryable=False)
    return [f"`{c}`" for c in kept]
