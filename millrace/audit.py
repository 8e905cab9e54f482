"""The audit of a statement that passed the guard: how well it covers what the question asks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .catalog import Catalog
from .guard import facts
from .sqlx import plan, tokens
from .sqlx.translate import translate

#: Penalties of the checks. Fixed values.
PENALTIES = {"nouns": 0.05, "grouping": 0.10, "average": 0.10, "percent": 0.08, "polarity": 0.10, "literal": 0.10, "number": 0.05, "output": 0.08, "entity": 0.12}


@dataclass
class Audit:
    warnings: list[str] = field(default_factory=list)
    penalty: float = 0.0
    coverage: float = 1.0
    hard_fail: bool = False

    def warn(self, kind: str, text: str) -> None:
        self.warnings.append(text)
        self.penalty = round(self.penalty + PENALTIES[kind], 4)


def outputs_asked(question: str) -> list[str]:
    """What a question wants to see, each of six words at most: the list after "including", else after "showing" or "along with"."""
    m = re.search(r"(?i)\bincluding\s+([^.?]+)", question) or re.search(r"(?i)\b(?:showing|along with)\s+([^.?]+)", question)
    listed = re.split(r"\s*(?:,|\band\b)\s*", re.split(r"(?i)\b(?:for|per|by|where|from|of all)\b", m[1])[0]) if m else []
    listed = [re.sub(r"(?i)^(?:the|their|its|all)\s+", "", x.strip().lower()) for x in listed]
    return [x for x in listed if x and len(x.split()) <= 6 and not re.match(r"those\b|none\b", x)]


def audit(spark: SparkSession, sql: str, question: str, catalog: Catalog) -> Audit:
    """Warnings with penalties; a statement that aggregates its own grouping key, or joins LEFT what it never uses, fails outright."""
    out, q = Audit(), question.lower()
    flat = tokens.mask(sql).lower()
    words = set(re.findall(r"[a-z]+", sql.lower().replace("_", " ")))
    root = facts.build(plan.parsed(spark, translate(sql, catalog.integers())))
    named = {s.name for b in root.all() for s in b.sources.values() if s.kind == "table"}
    # nouns of the question that are tables of the catalog
    for t in catalog.tables:
        stem = t.rstrip("s")
        if re.search(rf"\b{re.escape(stem)}s?\b", q) and t not in named:
            out.warn("entity" if len(named) == 1 and not any(n.rstrip("s") in q for n in named) else "nouns", f"{t} is asked about and not read")
    if re.search(r"\b(per|for each|by each)\s+[a-z]", q) and not re.search(r"group\s+by|partition\s+by", flat):
        out.warn("grouping", "asked by group, not grouped")
    if re.search(r"\b(average|mean)\b", q) and "avg" not in words:
        out.warn("average", "an average is asked for")
    if re.search(r"\bpercent(age)?\b", q) and "100" not in flat:
        out.warn("percent", "a percentage is asked for")
    if re.search(r"\b(without|never|no|not|none)\b", q) and not re.search(r"\bnot\b|is null|except|left join|<>|!=", flat):
        out.warn("polarity", "the question is negative, the statement isn't")
    for wanted in outputs_asked(question):
        if not any(w in words or w.rstrip("s") in words for w in wanted.split()):
            out.warn("output", f"{wanted} is asked for and not given")
    asked = [("literal", m) for m in re.findall(r"'([^']+)'", question)] + [("number", m) for m in re.findall(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])", question)]
    met = 0
    for kind, value in asked:
        if f"'{value.lower()}'" in sql.lower() or kind == "number" and re.search(rf"(?<![\w.]){re.escape(value)}(?![\w.])", sql):
            met += 1
        else:
            out.warn(kind, f"{value} of the question is not in the statement")
    out.coverage = met / len(asked) if asked else 1.0
    for b in root.all():
        for e in b.select:
            for name, call in facts.own_aggregates(e):
                arg = call.children[0] if call.children else None
                if name in ("count", "sum") and b.group and arg is not None and facts.is_column(arg) and any(facts.is_column(g) and facts.same(g, arg) for g in b.group):
                    out.hard_fail = True
                    out.warnings.append("aggregates its own grouping key")
        used = {plan.parts(c)[-2] for e in [*b.select, *b.where, *(b.group or [])] for c in facts.columns(e) if len(plan.parts(c)) > 1}
        bare = any(len(plan.parts(c)) == 1 for e in [*b.select, *b.where, *(b.group or [])] for c in facts.columns(e))
        star = any(n.kind == "UnresolvedStar" for e in b.select for n in e.walk())
        for j in b.joins:
            if j.kind == "LeftOuter" and j.condition is not None and not bare and not star and not any(facts.own_aggregates(e) for e in b.select):
                later = {plan.parts(c)[-2] for k in b.joins if k is not j and k.condition is not None for c in facts.columns(k.condition) if len(plan.parts(c)) > 1}
                literal = any(n.kind == "Literal" for t in facts.conjuncts(j.condition) for n in t.walk())
                if literal and not j.right & (used | later):
                    out.hard_fail = True
                    out.warnings.append("joins LEFT, with a filter, what it never uses")
    return out
