"""Tables with nulls everywhere, repeated rows, nothing at all, and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from chronopanel.functions import text as T
from chronopanel.operators import panel as P
from chronopanel.operators import recurrence as R
from chronopanel.operators import reports as S
from chronopanel.operators import vectors as V

EX = "course_id long, t int, exam_id long, ord double, label string, total_marks double, year int, calendar string, source_kind string, score double, k long"
QU = "question_id long, exam_id long, marks double, format string, parse_confidence double, is_optional boolean, exact_repeat boolean, para_repeat boolean, mass double"
MA = "question_id long, k long, node_id long, rank int, weight double, score double, status string, method string, share double"


@pytest.fixture
def tables(spark):
    e = [(1, 0, 10, 0.0, None, None, None, None, None, 1.0, 5), (1, 0, 10, 0.0, None, None, None, None, None, 2.0, 6), (1, 1, 11, 1.0, "x", 80.0, 2001, "AD", "u", None, None), (None, 0, 12, None, None, None, None, None, None, None, None)]
    q = [(1, 10, 5.0, None, None, None, None, None, 9.0), (1, 10, 5.0, None, None, None, None, None, 8.0), (2, 11, None, "odd", 0.5, True, True, False, None), (3, None, 1.0, "theory", 1.0, False, False, False, None), (None, 10, 1.0, "theory", 1.0, False, False, False, None)]
    m = [(1, 7, 1, 1, 1.0, 0.5, "A", "auto", 0.0), (1, 8, 1, 2, 1.0, None, None, None, 0.0), (2, 7, None, None, 1.0, 0.9, "B", "auto", 0.0), (3, 7, 1, 1, 1.0, 0.5, "A", "auto", 0.0), (4, 7, 1, 1, 1.0, 0.5, "A", "auto", 0.0), (None, 7, 1, 1, 1.0, 0.5, "A", "auto", 0.0), (1, None, 1, 1, 1.0, 0.5, "A", "auto", 0.0)]
    return spark.createDataFrame(e, EX), spark.createDataFrame(q, QU), spark.createDataFrame(m, MA)


def test_nulls_and_clashing_names(tables):
    e, q, m = tables
    obs = P.observations(e, q, m)
    assert {(r.t, r.k, r.question_id, r.share, r.format) for r in obs.collect()} == {(0, 7, 1, 2.5, "theory"), (0, 8, 1, 2.5, "theory"), (1, 7, 2, None, "theory")}
    c = {(r.t, r.k): (r.y, r.marks) for r in P.build_cells(e, obs, True).collect()}
    assert c == {(0, 7): (1, 2.5), (0, 8): (1, 2.5), (1, 7): (1, 0.0), (1, 8): (0, 0.0), (2, 7): (0, 0.0), (2, 8): (0, 0.0)}
    assert S.node_stats(obs).count() == 2 and S.evidence_profile(P.build_cells(e, obs), P.exams_once(e), obs).first().undated == 1


def test_empty(tables):
    e, q, m = (x.where("false") for x in tables)
    obs = P.observations(e, q, m)
    c = P.build_cells(e, obs, True)
    assert [x.count() for x in (obs, c, S.unit_coverage(obs, obs.select("course_id", "k", F.col("k").alias("unit")).distinct()), S.format_forecast(obs), S.cooccurrence(c), S.timeline(P.exams_once(e)))] == [0] * 6


def test_empty_links_and_search(spark):
    none = spark.createDataFrame([], "id_1 long, id_2 long")
    assert R.components(none).count() == 0
    v = spark.createDataFrame([], "id long, e array<float>")
    assert V.vector_search(v, "id", "e", v.select(F.col("id").alias("query_id"), "e")).count() == 0
    docs = spark.createDataFrame([], "question_id long, text string")
    counts = V.term_counts(docs, "question_id", T.tokens(F.col("text")))
    q = spark.createDataFrame([(1, "a")], "query_id long, prefix string")
    assert V.bm25(counts, "question_id", q).count() == 0 and V.tfidf(counts, "question_id").count() == 0


def test_self_links_and_ties(spark):
    links = spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "id_1 long, id_2 long")
    assert {(r.id, r.component) for r in R.components(links).collect()} == {(1, 1), (2, 1), (3, 3)}
    v = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "id long, e array<float>")
    got = V.vector_search(v, "id", "e", v.where("id = 0").select(F.col("id").alias("query_id"), "e"), 3, rows=2).collect()
    assert sorted(r.id for r in got) == [0, 1, 2]


def test_very_long_text(spark):
    long = "voltage of the pump " * 60_000
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "id long, text string")
    x = df.select("id", T.word_count(F.col("text")).alias("n"), F.size(T.content_terms(F.col("text"))).alias("c"), T.text_flags(F.col("text")).alias("f")).collect()
    assert x[0].n == 240_000 and x[0].c == 2 and "long" in x[0].f and x[1].n is None and x[2].f == ["empty"]


def test_members_without_rows(spark):
    """No course, no exam, no question: no rows, and no crash."""
    from chronopanel.operators import alignment as A
    from chronopanel.operators import members as B

    c = spark.createDataFrame([], "course_id long, t int, k long, y long, marks double, soft double, n_questions long, exact_repeat long, para_repeat long, semantic double, map_conf_sum double, parse_conf_sum double, marks_known_sum long, optional_sum long")
    u = spark.createDataFrame([], "course_id long, k long, unit long")
    post = B.posteriors(c, u)
    assert post.count() == 0 and B.generic_features(c, u, post).count() == 0
    q = spark.createDataFrame([], "course_id long, question_id long, t int, term string, own int, around int, lab_cue boolean, numbers int")
    n = spark.createDataFrame([], "course_id long, node_id long, is_lab boolean, term string, tf int")
    assert A.Aligner(q, n, spark.createDataFrame([], "ancestor_id long, node_id long")).run().count() == 0
