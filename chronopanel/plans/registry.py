"""All queries and oracles of the package; the llm subpackage adds its own in __spark_entry__."""

from __future__ import annotations

import importlib

MODULES = ["hierarchies", "panels", "forecasts", "texts", "reporting", "linkage", "modelling", "ingest", "services", "generated", "ensemble"]


def collected() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"chronopanel.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
