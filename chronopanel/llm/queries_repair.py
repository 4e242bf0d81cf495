"""Queries of problem 4."""

from __future__ import annotations

from chronopanel.llm import quality as Q
from chronopanel.llm import repair as R
from chronopanel.llm.queries_quality import read
from chronopanel.sources.tables import cut


def _inputs(spark, d):
    p, lines, furniture = read(spark, d)
    return lines, furniture, cut(Q.page_kinds(p, lines, furniture).select("page_id", "kind"))


QUERIES = {
    "p4_found": lambda spark, d: R.damaged_lines(*_inputs(spark, d)).select("page_id", "line_no", "kind").distinct(),
    "p4_paragraphs": lambda spark, d: R.paragraphs(*_inputs(spark, d)),
}
ORACLES: dict[str, str] = {}
