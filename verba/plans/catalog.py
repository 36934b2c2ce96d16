"""Every registered query (key -> Spark plan) and its DuckDB oracle (key -> SQL)."""

from __future__ import annotations

import importlib

_MODULES = ["q_text", "q_language", "q_models", "q_jobs", "q_people", "q_streams"]


def _load():
    queries, oracles = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"verba.plans.{name}")
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    return queries, oracles


def queries():
    return _load()[0]


def oracles():
    return _load()[1]
