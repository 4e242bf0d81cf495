"""Queries of merging, templates and invented papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions.stem import stems
from chronopanel.functions.text import tokens
from chronopanel.operators import generation as G
from chronopanel.operators import panel as P
from chronopanel.plans.forecasts import simple_scores
from chronopanel.plans.panels import PANEL, exams, observations, rounded, units
from chronopanel.plans.reporting import _Q, facts, questions


def _merge(spark, d):
    """Nodes that name a practical part against the others of their course."""
    f = facts(spark, d)
    p = f.select(F.col("node_id").alias("p"), F.col("title").alias("parent_title"))
    x = f.join(p, f["parent_id"] == p["p"], "left").where("title is not null and course_id is not null").select("course_id", "node_id", "parent_title", "title", F.array_contains("kinds", "lab").alias("lab"))
    return rounded(G.merge_titles(x.where("lab").drop("lab"), x.where("not coalesce(lab, false)").drop("lab")))


def _ranking(spark, d):
    end = P.exams_once(exams(spark, d)).groupBy("course_id").agg((F.max("t") + 1).alias("cutoff"))
    return simple_scores(spark, d).where("model = 'bayes'").join(end, ["course_id", "cutoff"]).select("course_id", "k", "score")


QUERIES = {
    "stemmed_terms": lambda s, d: questions(s, d, "text").where("text is not null").select("question_id", F.array_join(stems(tokens(F.col("text"))), "|").alias("stems")),
    "merge_titles": _merge,
    "numeric_templates": lambda s, d: questions(s, d, "text").where("text is not null").select("question_id", G.numeric_template(F.col("text")).alias("template")),
    "proper_nouns": lambda s, d: questions(s, d, "text").where("text is not null").select("question_id", F.array_join(G.proper_nouns(F.col("text")), "|").alias("names")),
    "item_formats": lambda s, d: G.item_formats(observations(s, d)),
    "representatives": lambda s, d: G.representatives(observations(s, d), questions(s, d, "text")),
    "invented_papers": lambda s, d: G.invented_papers(_ranking(s, d), units(s, d)),
}
_UNIT = "(kPa|kHz|kN|kJ|kW|kg|Hz|ohm|bar|rpm|litres|min|mol|mm|cm|kV|Pa|N|J|W|V|A|K|m|s)"
_TPL = f"regexp_replace(regexp_replace(text, '\\b\\d+(?:\\.\\d+)?\\s*{_UNIT}\\b', '[value in \\1]', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '[value]', 'g')"
_FMT = "per AS (SELECT course_id, k, format, count(DISTINCT t) AS exams, count(*) AS n FROM obs GROUP BY ALL), fm AS (SELECT course_id, k, format, CASE WHEN exams >= 2 THEN 'history' ELSE 'weak' END AS basis FROM per QUALIFY row_number() OVER (PARTITION BY course_id, k ORDER BY exams DESC, n DESC, format) = 1)"
ORACLES = {
    "numeric_templates": _Q + f"SELECT question_id, {_TPL} AS template FROM q WHERE text IS NOT NULL",
    "proper_nouns": _Q + "SELECT question_id, coalesce(array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|'), '') AS names FROM (SELECT question_id, regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]{2,})\\b', 1) AS l FROM q WHERE text IS NOT NULL)",
    "item_formats": PANEL + ", " + _FMT + " SELECT * FROM fm",
    "representatives": PANEL
    + ", "
    + _FMT
    + f", r AS (SELECT obs.course_id, obs.k, obs.question_id FROM obs JOIN fm USING (course_id, k, format) QUALIFY row_number() OVER (PARTITION BY obs.course_id, obs.k ORDER BY obs.t DESC, obs.score DESC NULLS LAST, obs.question_id) = 1), tx AS (SELECT DISTINCT question_id, text FROM questions) SELECT course_id, k, question_id, {_TPL} AS template FROM r LEFT JOIN tx USING (question_id)",
}
