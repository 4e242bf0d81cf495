"""Fits of many groups at once against the same fits one by one, and folds by one sort."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronopanel.operators import metrics as M
from chronopanel.operators import models as L

from test_panel import cells


def test_posteriors_of_many_groups_are_those_of_each():
    rng = np.random.default_rng(2)
    size, n = [1, 5, 40, 3], np.array([4.0, 2.5, 6.0, 0.0])
    of = np.repeat(np.arange(4), size)
    h = np.floor(rng.random(len(of)) * n[of]) + 0.25 * (n[of] % 1 > 0)
    unit, alone = rng.integers(0, 4, len(of)), of == 2
    a, b, mu, kappa = L.posteriors_of(h, n, unit, alone, of)
    for i in range(4):
        on = of == i
        one = L.posterior(h[on], n[i], None if alone[on].all() else unit[on])
        assert np.allclose(a[on], one[0], atol=1e-9) and np.allclose(b[on], one[1], atol=1e-9) and np.allclose(mu[on], one[2]) and math.isclose(kappa[i], one[3], abs_tol=1e-9)


def test_hidden_states_of_one_group_dont_see_another():
    rng = np.random.default_rng(3)
    a, b = (rng.random((4, n)) < 0.4 for n in (5, 9))
    both = L._hidden_states(np.hstack([a, b]).astype(float), np.ones(14), np.repeat([0, 1], [5, 9]), 60)
    alone = [L._hidden_states(y.astype(float), np.ones(y.shape[1]), np.zeros(y.shape[1], int), 60) for y in (a, b)]
    assert np.allclose(both, np.concatenate(alone))
    # Counting a history twice is the same as having it twice.
    assert np.allclose(L._hidden_states(np.hstack([a, a]).astype(float), np.ones(10), np.zeros(10, int), 60)[:5], L._hidden_states(a.astype(float), np.full(5, 2.0), np.zeros(5, int), 60))


def test_groups_stay_whole_across_batches(spark):
    """Batches of three rows: groups of one to eight rows reach the fit whole, several in a call where they fit."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(g, i) for g in range(1, 9) for i in range(g)], "g long, i long")
        got = L.in_groups(df, ("g",), lambda x, of: pd.DataFrame({"g": x["g"], "n": np.bincount(of)[of]}), "g long, n long").distinct().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.g, r.n) for r in got) == [(g, g) for g in range(1, 9)]


def test_a_fold_is_sorted_once(spark):
    s = spark.createDataFrame([(1, k, 1, "m", float(k % 2), int(k < 2), [0.7, 0.3, 0.0][min(k, 2)]) for k in range(5)], "course_id long, k long, cutoff int, model string, score double, rel int, gain double")
    folds = M.fold_metrics(s, spark.createDataFrame([(1, 3)], "course_id long, top_k long"))
    r = folds.first()
    disc = [1 / math.log2(i + 2) for i in range(3)]  # order by score, then item: 1, 3, 0
    assert math.isclose(r.ndcg, (disc[0] + disc[2]) / (disc[0] + disc[1])) and math.isclose(r.ndcg_marks, (0.3 * disc[0] + 0.7 * disc[2]) / (0.7 * disc[0] + 0.3 * disc[1]))
    assert math.isclose(r.average_precision, (1 + 2 / 3) / 2)
    plan = folds._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_cooccurrence_is_one_pass_without_pairs(spark):
    from chronopanel.operators import features as X

    f = X.cooccurrence_feature(cells(spark, [[1, 0], [0, 1], [1, 0], [0, 0]], True))
    assert f._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    got = {(r.k, r.cutoff): r.cooc_lift_last for r in f.where(F.col("cutoff") > 0).collect()}
    # Cutoff 3: item 0 came last, once before with a successor (item 1), so n = 1: (1 + 2 base) / 3 and 2 base / 3 over base.
    assert math.isclose(got[1, 3], math.log((1 / 3 + 1 / 3 * 2 / 3) / (1 / 3 + 1e-6))) and math.isclose(got[0, 3], math.log((2 / 3 * 2 / 3) / (2 / 3 + 1e-6)))
    assert got[0, 4] == 0


def test_strings_of_joined_frames_go_back_to_spark(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(2)], "g long, i long")
    fit = lambda x, of: pd.concat([pd.DataFrame({"what": pd.array([w] * 2, dtype="string[pyarrow]")}) for w in ("a", "b")])
    assert {r.what for r in L.in_groups(df, ("g",), fit, "what string").collect()} == {"a", "b"}


def test_batches_without_a_result_row_give_none(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(2)], "g long, i long")
    kept = lambda x, of: x.assign(what="a")[["g", "what"]][x["g"] == 1] if (x["g"] == 1).any() else pd.DataFrame({"g": [], "what": []}, dtype=float)
    assert L.in_groups(df.repartition(3), ("g",), kept, "g long, what string").count() == 2
    assert L.in_groups(df.where("g > 1"), ("g",), lambda x, of: pd.DataFrame({"g": [], "what": []}, dtype=float), "g long, what string").collect() == []
