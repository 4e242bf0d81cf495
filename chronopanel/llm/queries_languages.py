"""Queries of problem 8."""

from __future__ import annotations

from chronopanel.llm import languages as L
from chronopanel.sources.tables import table


def _segments(spark, d):
    docs = table(spark, d, "documents")
    return L.segments(L.line_languages(docs, L.fit(docs, table(spark, d, "lang_codes"))))


QUERIES = {
    "p8_found": lambda spark, d: L.wrong_lines(table(spark, d, "documents"), table(spark, d, "lang_codes")).distinct(),
    "p8_segments": _segments,
    "p8_documents": lambda spark, d: L.document_languages(table(spark, d, "documents"), table(spark, d, "lang_codes")),
}
ORACLES: dict[str, str] = {}
