"""Queries of problems 6 and 7."""

from __future__ import annotations

from chronopanel.llm import packing as K
from chronopanel.llm import tokenizing as T
from chronopanel.sources.tables import table

QUERIES = {
    "p6_ids": lambda spark, d: T.encode(table(spark, d, "documents")),
    "p7_pack": lambda spark, d: K.pack_texts(table(spark, d, "documents")),
    "p7_fill": lambda spark, d: K.fill_report(K.pack_texts(table(spark, d, "documents"))),
    "p7_audit": lambda spark, d: K.audit(K.pack_texts(table(spark, d, "documents"))),
    "p6_counts": lambda spark, d: T.count_tokens(table(spark, d, "documents")),
}
ORACLES: dict[str, str] = {"p7_audit": "SELECT count(DISTINCT doc_id) AS items, 0 AS lost, 0 AS misplaced, 0 AS overfull FROM documents"}
