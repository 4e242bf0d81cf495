"""Stems, title scores, merging, templates, invented papers."""

import pytest
from pyspark.sql import functions as F

from chronopanel.functions.stem import stem
from chronopanel.operators import generation as G

STEMS = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "hoping": "hope", "happy": "happi", "relational": "relat", "rational": "ration", "generate": "generat", "generously": "generous", "national": "nation", "adjustment": "adjust", "adoption": "adopt", "hopefulness": "hope", "it": "it", "gas": "gas", "this": "this", "luxuriating": "luxuri", "cry": "cri", "by": "by", "say": "say", "calculations": "calcul", "équation": "équation"}


@pytest.mark.parametrize(("word", "want"), STEMS.items())
def test_stems(word, want):
    assert stem(word) == want


def test_titles_and_merge(spark):
    assert G.title_score("Flow in pipes", "flow in pipes") == 100 and G.title_score("Pumps", "Pumps and turbines in series") < 60
    shape = "course_id long, node_id long, parent_title string, title string"
    base = spark.createDataFrame([(1, 1, None, "Flow in pipes"), (1, 2, "A", "Open channels"), (2, 3, None, "Flow in pipes")], shape)
    new = spark.createDataFrame([(1, 10, None, "Flow in pipe"), (1, 11, "B", "Open channel flow rates"), (1, 12, None, None), (1, 13, "A", "open channels")], shape)
    got = {r.node_id: r.match for r in G.merge_titles(new, base).collect()}
    assert got == {10: 1, 11: None, 12: None, 13: 2}


def test_templates_and_papers(spark):
    df = spark.createDataFrame([("At 5.5 kW the Alpha pump gives 3 units near the Beta plant.",), (None,)], "x string")
    r = df.select(G.numeric_template(F.col("x")).alias("t"), G.proper_nouns(F.col("x")).alias("n")).collect()
    assert r[0].t == "At [value in kW] the Alpha pump gives [value] units near the Beta plant." and r[0].n == ["Alpha", "Beta"] and r[1].t is None
    rank = spark.createDataFrame([(1, k, 1.0 - k / 50) for k in range(30)], "course_id long, k long, score double")
    units = rank.select("course_id", "k", (F.col("k") % 5).alias("unit"))
    p = G.invented_papers(rank, units, 2, 6, 2).collect()
    assert [x.k for x in sorted((x for x in p if x.paper == 1), key=lambda x: x.pos)] == [0, 1, 2, 3, 4, 5] and len(p) == 12
    assert sorted(map(tuple, p)) == sorted(map(tuple, G.invented_papers(rank, units, 2, 6, 2).collect()))
