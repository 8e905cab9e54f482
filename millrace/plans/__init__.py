"""Registered queries, each beside its oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil


def modules() -> list:
    """The query modules of this package, by name; each has QUERIES and ORACLE_SQL."""
    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_"))
    return [importlib.import_module(f"{__name__}.{n}") for n in names]
