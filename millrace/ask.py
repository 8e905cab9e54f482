"""Question to rows: understand, retrieve, have SQL written, guard and repair it, calibrate, audit, run.

Writing SQL is a port (``SqlProvider``): a hosted or local model can be put behind it. The provider
here is a deterministic stand-in that fills templates over the join path of the tables a question
names; its answers are no measure of quality.
"""

from __future__ import annotations

import re
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import audit, autofix
from .catalog import Catalog
from .functions import ambiguity
from .functions import questions as Q
from .guard.check import Verdict
from .operators.joinpaths import JoinGraph
from .sqlx.execute import Engine, Result


@dataclass
class Parsed:
    question: str
    clean: str
    intent: str
    entities: list[str]
    requirements: dict
    ambiguous: bool = False
    choices: tuple[str, ...] = ()  # what ambiguous terms were taken for


@dataclass
class Answer:
    question: str
    sql: str = ""
    result: Result | None = None
    confidence: float = 0.0
    retries: int = 0
    coverage: float = 1.0
    warnings: list[str] = field(default_factory=list)
    error: str = ""
    latency_ms: dict[str, float] = field(default_factory=dict)
    autofixed: bool = False
    options: tuple[str, ...] = ()  # to ask back with


#: Confidence under which a statement is written anew once, and coverage under which the audit asks for another. Fixed values.
CONFIDENT, COVERED = 0.80, 0.70


def calibrated(sql: str, retries: int, autofixed: bool, penalty: float) -> float:
    """The confidence in a statement that passed, as ``operators.evaluate.calibrate`` has it, less the audit's penalty."""
    flat = sql.lower()
    less = 0.15 * bool(re.search(r"\b\w*id\s+i?like\b", flat)) + 0.10 * (len(re.findall(r"\bselect\b", flat)) > 3)
    return max(0.0, round(0.95 - less - 0.03 * retries - 0.05 * autofixed - penalty, 4))


class SqlProvider(ABC):
    @abstractmethod
    def complete(self, parsed: Parsed, catalog: Catalog, error: str = "") -> str:
        """SQL for a question; ``error`` is the guard's message on the last try."""


class TemplateProvider(SqlProvider):
    """Counts, sums and averages over a join path, grouped by the first text column of the last table named."""

    def complete(self, parsed: Parsed, catalog: Catalog, error: str = "") -> str:
        wanted = [t for t in parsed.entities if t in catalog]
        if not wanted:
            return ""
        path = JoinGraph.of(catalog).path(wanted)
        source = path[0].sql() if path else f"FROM {wanted[0]}"
        numeric = next((c.name for c in catalog[wanted[0]].columns.values() if c.family == "numeric" and c.name not in catalog[wanted[0]].sensitive), None)
        kind = parsed.requirements.get("aggregate")
        value = f"avg({numeric})" if kind == "average" and numeric else f"sum({numeric})" if kind == "sum" and numeric else "count(*)"
        if kind is None and parsed.intent == "lookup":
            return f"SELECT {wanted[0]}.* {source} LIMIT 100"
        group = None
        if parsed.requirements.get("grouping") and len(wanted) > 1:
            t = catalog[wanted[-1]]
            group = next((c.name for c in t.columns.values() if c.family == "string"), None)
        return f"SELECT {f'{group}, ' if group else ''}{value} AS value {source}{f' GROUP BY {group} ORDER BY {group}' if group else ''}"


class TokenBucket:
    """Waits until ``cost`` tokens (at most the capacity) are there; they refill at ``rate`` a second."""

    def __init__(self, rate: float, capacity: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.capacity, self.clock, self.sleep = rate, capacity, clock, sleep
        self.tokens, self.last, self.lock = capacity, clock(), threading.Lock()

    def take(self, cost: float) -> float:
        """Seconds waited."""
        cost, waited = min(cost, self.capacity), 0.0
        while True:
            with self.lock:
                now = self.clock()
                self.tokens = min(self.capacity, self.tokens + (now - self.last) * self.rate)
                self.last = now
                if self.tokens >= cost - 1e-9:
                    self.tokens -= cost
                    return waited
                wait = (cost - self.tokens) / self.rate
            self.sleep(wait)
            waited += wait


class Assistant:
    """Questions to guarded SQL and rows. ``specs``: terms that may mean several things, see ``functions.ambiguity``."""

    def __init__(self, engine: Engine, provider: SqlProvider | None = None, retries: int = 2, specs: list[ambiguity.Spec] | None = None):
        self.engine, self.provider, self.retries, self.specs = engine, provider or TemplateProvider(), retries, specs or []
        self.spark: SparkSession = engine.spark
        self.catalog: Catalog = engine.catalog

    def vocabulary(self) -> list[tuple[str, str]]:
        """Terms for the catalog's tables: the name, its singular or plural, and its words apart."""
        out = {}
        for t in self.catalog.tables:
            words = t.replace("_", " ")
            for term in (words, words.rstrip("s"), f"{words.rstrip('s')}s", re.sub(r"y$", "ies", words)):
                out.setdefault(term, t)
        return sorted(out.items())

    def understand(self, question: str) -> Parsed:
        df = self.spark.createDataFrame([(0, question)], "query_id int, question string")
        df = df.withColumn("question", Q.expand(F.col("question")))
        r = df.select("question", Q.intent(F.col("question")).alias("i"), Q.requirements(F.col("question")).alias("r")).first()
        found = Q.entities(df, self.spark.createDataFrame(self.vocabulary(), "term string, table_name string"), least=82.0).first()
        return Parsed(question, r["question"], r["i"], list(found["entities"]) if found else [], r["r"].asDict(), ambiguous=not found)

    def ask(self, question: str, tenant: int | None = None, dry: bool = True) -> Answer:
        """The guarded SQL of a question, and its rows unless ``dry``.

        Refused statements are repaired where that makes them pass, else written anew with the refusal's text. One of little confidence is
        written anew once, and one that covers too little of the question too; the new one counts only if it is better.
        """
        a, start = Answer(question), time.time()
        mark = lambda name, since: a.latency_ms.__setitem__(name, round(1000 * (time.time() - since), 1))
        parsed = self.understand(question)
        routing = ambiguity.route(question, parsed.entities, self.specs)
        mark("understand", start)
        if routing.ambiguous:
            a.error, a.options = f"ambiguous: {routing.term} may mean {' or '.join(routing.options)}", routing.options
            return a
        if parsed.ambiguous:
            a.error = "ambiguous: no table of the catalog is named"
            return a
        parsed.choices = routing.chosen
        t = time.time()
        sql = self.provider.complete(parsed, self.catalog)
        mark("generate", t)
        t = time.time()
        self._settle(a, parsed, sql, tenant)
        if not a.error and a.confidence < CONFIDENT:
            self._better(a, parsed, "the confidence is low: " + "; ".join(a.warnings), tenant, lambda new: new.confidence > a.confidence)
        if not a.error and a.coverage < COVERED:
            self._better(a, parsed, "the question is not covered: " + "; ".join(a.warnings), tenant, lambda new: new.coverage > a.coverage)
        mark("validate", t)
        if a.error:
            return a
        if not dry:
            t = time.time()
            a.result = self.engine.execute_query(a.sql, tenant, question=question)
            mark("execute", t)
            if not a.result.verdict.passed:
                a.error = f"{a.result.verdict.step}: {a.result.verdict.message}"
        mark("total", start)
        return a

    def _settle(self, a: Answer, parsed: Parsed, sql: str, tenant: int | None) -> None:
        """Guards, repairs, retries and audits a statement into ``a``."""
        seen: dict[str, Verdict] = {}

        def verdict(text: str) -> tuple[bool, str, bool]:
            v = seen[text] = self.engine.verdict(text, tenant)
            return v.passed, f"{v.step}: {v.message}", v.retryable

        def again(text: str, error: str) -> str | None:
            for fixed in autofix.repairs(text, error, self.catalog):
                if verdict(fixed)[0]:
                    a.autofixed = True
                    return fixed
            return self.provider.complete(parsed, self.catalog, error) or None

        a.sql, passed, errors = autofix.retry(sql, verdict, again, self.retries)
        a.retries = len(errors)
        if not passed:
            a.error = errors[-1] if errors else "no SQL"
            return
        found = audit.audit(self.spark, a.sql, a.question, self.catalog)
        a.warnings, a.coverage = [*found.warnings, *seen[a.sql].advice], found.coverage
        a.confidence = calibrated(a.sql, a.retries, a.autofixed, found.penalty)
        if found.hard_fail:
            a.error = found.warnings[-1]

    def _better(self, a: Answer, parsed: Parsed, error: str, tenant: int | None, is_better: Callable[[Answer], bool]) -> None:
        """Has the statement written anew and takes the new one over if it passes and is better."""
        sql = self.provider.complete(parsed, self.catalog, error)
        if not sql or sql == a.sql:
            return
        new = Answer(a.question)
        self._settle(new, parsed, sql, tenant)
        if not new.error and is_better(new):
            a.sql, a.warnings, a.coverage, a.confidence, a.autofixed = new.sql, new.warnings, new.coverage, new.confidence, new.autofixed
            a.retries += 1 + new.retries
