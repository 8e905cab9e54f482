"""Terms that may mean several things, and whether a question says which (the router)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: An option is taken without asking back if it scores so much, and leads the next by so much. Fixed values.
THRESHOLD, MARGIN = 0.75, 0.10


@dataclass(frozen=True)
class Spec:
    """``term`` may mean any of ``options`` (texts that name tables); a question with one of ``resolvers`` says which itself."""

    term: str
    options: tuple[str, ...]
    resolvers: tuple[str, ...] = ()

    def triggered(self, question: str) -> bool:
        return _word(self.term, question)

    def resolved(self, question: str) -> bool:
        return any(_word(r, question) for r in self.resolvers)


@dataclass
class Routing:
    ambiguous: bool
    term: str = ""
    options: tuple[str, ...] = ()
    chosen: tuple[str, ...] = ()


def _word(term: str, text: str) -> bool:
    return bool(re.search(rf"\b{re.escape(term.lower())}\b", text.lower()))


def overlap(question: str, option: str) -> float:
    """A deterministic stand-in for a sentence encoder: the share of the option's words (three letters or more) that the question has."""
    words = {w for w in re.findall(r"[a-z]+", option.lower()) if len(w) >= 3}
    asked = set(re.findall(r"[a-z]+", question.lower()))
    return sum(w in asked or w.rstrip("s") in asked or f"{w}s" in asked for w in words) / len(words) if words else 0.0


def route(question: str, entities: list[str], specs: list[Spec], score: Callable[[str, str], float] = overlap) -> Routing:
    """Whether the question must be asked back: the first term that neither a resolver, nor the tables it names, nor a clear score settles.

    Tables settle a term if they fit exactly one of its options. ``score`` (question, option) is a port.
    """
    chosen: list[str] = []
    for spec in specs:
        if not spec.triggered(question) or spec.resolved(question):
            continue
        fitting = [o for o in spec.options if any(_word(t, o) for t in entities)]
        if len(fitting) == 1:
            continue
        ranked = sorted(((score(question, o), o) for o in spec.options), key=lambda x: (-x[0], x[1]))
        if ranked and ranked[0][0] >= THRESHOLD and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0.0) >= MARGIN:
            chosen.append(ranked[0][1])
        else:
            return Routing(True, spec.term, spec.options, tuple(chosen))
    return Routing(False, chosen=tuple(chosen))
