"""Queries of problem 5, over titles and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.llm import lookalikes as A
from chronopanel.operators.hierarchy import latest
from chronopanel.sources.tables import table


def nodes(spark, d):
    """The latest row of each node."""
    return latest(table(spark, d, "tree"), "node_id", "loaded_at", ["title", "syllabus_version_id"])


def pages(spark, d, *columns):
    """Each page with non-empty text once: rows of the same page_id are identical."""
    rows = table(spark, d, "document_page").select("page_id", "text", *columns).where("page_id is not null and text <> ''")
    return rows.groupBy("page_id").agg(F.max(F.struct("text", *columns)).alias("r")).select("page_id", "r.*")


def _found(spark, d):
    titles = A.alike_pairs(nodes(spark, d), "node_id", "title", "syllabus_version_id").select(F.lit("title").alias("field"), "id_1", "id_2")
    return titles.unionByName(A.alike_pairs(pages(spark, d), "page_id", "text").select(F.lit("page").alias("field"), "id_1", "id_2"))


def _forms(spark, d):
    titles = A.forms(nodes(spark, d), "title", "node_id").select(F.lit("title").alias("field"), F.col("node_id").alias("id"), "form")
    return titles.unionByName(A.forms(pages(spark, d), "text", "page_id").select(F.lit("page").alias("field"), F.col("page_id").alias("id"), "form"))


QUERIES = {"p5_found": _found, "p5_forms": _forms}
_TEXTS = f"""
WITH n AS (SELECT node_id AS id, title AS t, syllabus_version_id AS scope FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC) AS r FROM tree WHERE node_id IS NOT NULL) WHERE r = 1),
p AS (SELECT DISTINCT page_id AS id, text AS t FROM document_page WHERE page_id IS NOT NULL AND text <> ''),
x AS (SELECT 'title' AS field, id, scope, t, {A.form_sql("t")} AS form FROM n UNION ALL SELECT 'page', id, 0, t, {A.form_sql("t")} FROM p)
"""
ORACLES: dict[str, str] = {
    "p5_forms": _TEXTS + "SELECT field, id, form FROM x",
    "p5_found": _TEXTS + "SELECT a.field, a.id AS id_1, b.id AS id_2 FROM x a JOIN x b ON a.field = b.field AND a.scope = b.scope AND a.form = b.form AND a.id < b.id WHERE a.t <> b.t",
}
