"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.llm import neardup as N
from chronopanel.sources.tables import table

#: What counts as a copy of a question.
OVERLAP, WORDS = 0.65, 12


def _linked(spark, d):
    return N.near_duplicates(table(spark, d, "questions").select("question_id", "text"), "question_id", "text", OVERLAP, WORDS)


def _found(spark, d):
    return N.expanded_pairs(*_linked(spark, d)).toDF("question_id_1", "question_id_2")


QUERIES = {
    "p3_found": _found,
    "p3_links": lambda spark, d: _linked(spark, d)[0].select("rep_1", "rep_2", F.round("overlap", 6).alias("overlap")),
    "p3_classes": lambda spark, d: N.linked_classes(*_linked(spark, d)).withColumnRenamed("id", "question_id"),
    "p3_groups": lambda spark, d: N.groups(*_linked(spark, d)).withColumnRenamed("id", "question_id"),
}
#: Exact: pairs of bags meet on (word, occurrence), all of them. Copies of one text are pairs, too.
_EXACT = f"""
WITH q AS (SELECT DISTINCT question_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM questions WHERE question_id IS NOT NULL AND text IS NOT NULL),
e AS (SELECT id, len(w) AS n, unnest(w) AS word FROM q WHERE len(w) >= {WORDS}), o AS (SELECT id, n, word, row_number() OVER (PARTITION BY id, word) AS nth FROM e),
p AS (SELECT a.id AS id_1, b.id AS id_2, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared FROM o a JOIN o b ON a.word = b.word AND a.nth = b.nth AND a.id < b.id WHERE least(a.n, b.n) >= {OVERLAP} * greatest(a.n, b.n) GROUP BY ALL),
f AS (SELECT id_1, id_2, shared / (total - shared) AS overlap FROM p WHERE shared >= {OVERLAP} * (total - shared))
"""
#: rep: the least id of those with the same bag of words.
_BAGS = _EXACT + ", b AS (SELECT id, string_agg(word, ' ' ORDER BY word) AS bag FROM e GROUP BY 1), r AS (SELECT id, min(id) OVER (PARTITION BY bag) AS rep FROM b) "
ORACLES: dict[str, str] = {
    "p3_found": _EXACT + "SELECT id_1 AS question_id_1, id_2 AS question_id_2 FROM f",
    "p3_links": _BAGS + "SELECT x.id AS rep_1, y.id AS rep_2, round(overlap, 6) AS overlap FROM f JOIN r x ON x.id = id_1 AND x.id = x.rep JOIN r y ON y.id = id_2 AND y.id = y.rep WHERE x.rep <> y.rep",
    "p3_groups": _EXACT.replace("WITH q", "WITH RECURSIVE q", 1)
    + ", g AS (SELECT id_1 AS a, id_2 AS b FROM f UNION SELECT id_2, id_1 FROM f), c AS (SELECT a AS id, b FROM g UNION SELECT c.id, g.b FROM c JOIN g ON c.b = g.a) SELECT id AS question_id, least(id, min(b)) AS group_id FROM c GROUP BY id",
    "p3_classes": _BAGS + "SELECT id AS question_id, rep AS class_id, count(*) AS n_links FROM (SELECT id_1 AS id FROM f UNION ALL SELECT id_2 FROM f) JOIN r USING (id) GROUP BY ALL",
}
