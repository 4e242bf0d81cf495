"""Candidates of fuzzy joins against all pairs."""

import os
import re

import pytest

from chronopanel.operators import generation as G
from chronopanel.operators import recurrence as R

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = r"[^\W\d_][^\W_]*|[0-9]+(?:\.[0-9]+)?"


def sharing(rows):
    """Pairs of (course_id, node_id, title) of one course with a common word."""
    x = [(c, n, set(re.findall(WORD, t.lower()))) for c, n, t in rows if c is not None and t is not None]
    return {(m, n) for c, m, v in x for d, n, w in x if c == d and m < n and v & w}


def test_title_pairs_of_short_words(spark):
    rows = [(1, 1, "Heat"), (1, 2, "Heat pumps"), (1, 3, "Pumps and the heat"), (2, 4, "heat"), (1, 5, "The beam"), (1, 6, None), (1, 7, "12"), (1, 8, "Review"), (1, 9, "review 12"), (None, 10, "Heat")]
    got = [(r.n1, r.n2) for r in R.title_pairs(spark.createDataFrame(rows, "course_id long, node_id long, title string"), "course_id").collect()]
    assert sorted(got) == [(1, 2), (1, 3), (2, 3), (3, 5), (7, 9), (8, 9)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_fuzzy_titles_all_pairs(spark):
    from chronopanel.plans.linkage import QUERIES
    from chronopanel.plans.reporting import facts

    rows = [(r.course_id, r.node_id, r.title) for r in facts(spark, DATA).select("course_id", "node_id", "title").collect()]
    title = {n: (t or "").lower() for _, n, t in rows}
    got = {(r.n1, r.n2): r for r in QUERIES["fuzzy_titles"](spark, DATA).collect()}
    assert set(got) == sharing(rows) and got
    assert QUERIES["fuzzy_titles"](spark, DATA).count() == len(got)
    for (a, b), r in got.items():
        want = R.indel_ratio(title[a], title[b]), R.token_sort_ratio(title[a], title[b]), R.token_set_ratio(title[a], title[b])
        assert (r.ratio, r.token_sort, r.token_set) == pytest.approx(want, abs=1e-5)


def best(new, base):
    """Each new node's best base node over all pairs of its course."""
    out = {}
    for c, n, p, t in new:
        x = [(p == q and s >= 86, s, -m) for d, m, q, u in base if c == d and t and u and ((s := G.title_score(t, u)) >= 90 or (s >= 86 and p == q))]
        out[n] = (-max(x)[2], round(max(x)[1], 4)) if x else None
    return out


def test_merge_titles_without_an_equal_word(spark):
    shape = "course_id long, node_id long, parent_title string, title string"
    base = [(1, 1, "A", "Reviews"), (1, 2, None, "Applications"), (1, 3, "B", "AC"), (1, 4, None, "Lithostirring in soils"), (1, 5, "A", None), (1, 6, "A", "..."), (2, 7, "A", "Review")]
    new = [(1, 10, "A", "Review"), (1, 11, "B", "A\u0440plications"), (1, 12, "A", "ac"), (1, 13, "A", "Litho\u200bstirring in soil"), (1, 14, "A", "---"), (1, 15, "A", None), (1, 16, "A", "Thermodynamics")]
    got = {r.node_id: r.match and (r.match, round(r.score, 4)) for r in G.merge_titles(spark.createDataFrame(new, shape), spark.createDataFrame(base, shape)).collect()}
    assert got == best(new, base) and {n: m and m[0] for n, m in got.items()} == {10: 1, 11: 2, 12: 3, 13: 4, 14: None, 15: None, 16: None}
    titles = [t for *_, t in new + base if t]
    assert all(G.may_reach(a, b, 86) or G.title_score(a, b) < 86 for a in titles for b in titles)


def test_set_ratio_bound():
    texts = ["define the heat pump", "define a heat pump", "the heat pump define", "heat", "heats", "pumps heating", "explain reheating of pumps", "explain the reheating of pump", "a b c", "", "a b c d e f g h"]
    for least in (60.0, 80.0, 92.0, 100.0):
        for a in texts:
            for b in texts:
                assert R.set_ratio_reaches(frozenset(a.split()), frozenset(b.split()), least) == (R.token_set_ratio(a, b) >= least), (a, b, least)


def test_duplicate_exams_by_string_ratio(spark):
    paper = ["derive the continuity equation of a fluid", "explain pumps", "define viscosity of oils", "sketch a hydraulic ram", "state the law of pascal"]
    near = [t.replace("hydraulic", "hydraullic").replace("continuity", "continuty") for t in paper]
    rows = [(1, 10, t) for t in paper] + [(1, 11, t) for t in near[:4]] + [(1, 12, t) for t in near[:3]] + [(2, 13, t) for t in paper] + [(1, 14, "explain pumps"), (1, 15, "explain pumps"), (1, 15, "explain pumps"), (1, 15, None), (1, 15, "")]
    df = spark.createDataFrame([(c, e, i, t) for i, (c, e, t) in enumerate(rows)], "course_id long, exam_id long, question_id long, text string")
    got = {(r.exam_1, r.exam_2): (r.matched, round(r.share, 4)) for r in R.duplicate_exams(df).collect()}
    assert got == {(10, 11): (4, 0.8), (14, 15): (2, 1.0)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_duplicate_exams_all_pairs(spark):
    from chronopanel.plans.linkage import QUERIES, _papers

    papers = {}
    for r in _papers(spark, DATA).where("text <> ''").collect():
        papers.setdefault((r.course_id, r.exam_id), []).append(r.text)
    want = {}
    for (c, a), one in papers.items():
        for (d, b), two in papers.items():
            if c == d and a < b and len(two) >= 2:
                n = sum(any(R.token_set_ratio(x, y) >= 92 for y in one) for x in two)
                if n / max(len(one), len(two)) >= 0.8:
                    want[a, b] = n
    assert {(r.exam_1, r.exam_2): r.matched for r in QUERIES["duplicate_exams"](spark, DATA).collect()} == want
