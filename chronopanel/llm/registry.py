"""All queries and oracles of the llm subpackage."""

from __future__ import annotations

import importlib

MODULES = ["queries_tokens", "queries_languages", "queries_pages", "queries_quality", "queries_repair", "queries_neardup"]


def collected() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"chronopanel.llm.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
