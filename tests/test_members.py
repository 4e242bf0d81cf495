"""Members of the ensemble, alignment and streams on small known cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import numerics as N
from chronopanel.functions import text as T
from chronopanel.operators import alignment as A
from chronopanel.operators import members as B
from chronopanel.operators import metrics as M
from chronopanel.operators import models as L
from chronopanel.operators import panel as P
from chronopanel.operators import review as V
from chronopanel.operators import trees
from chronopanel.sources import tables
from chronopanel.streaming import flows

from test_panel import cells


def units_of(spark, n):
    return spark.createDataFrame([(1, k, k % 2) for k in range(n)], "course_id long, k long, unit long")


def random_y(seed, steps=7, items=6):
    rng = np.random.default_rng(seed)
    return (rng.random((steps, items)) < 0.4).astype(int).tolist()


def test_special_functions_agree_with_the_plain_ones():
    rng = np.random.default_rng(4)
    a, b, x = rng.uniform(0.05, 40, 200), rng.uniform(0.05, 40, 200), rng.uniform(0, 1, 200)
    assert np.allclose(N.beta_cdfs(x, a, b), [N.beta_cdf(*v) for v in zip(x, a, b, strict=True)], atol=1e-8)
    assert np.allclose(N.beta_quantiles(0.1, a, b), [N.beta_quantile(0.1, *v) for v in zip(a, b, strict=True)], atol=1e-6)


def test_posterior_by_hand():
    """Without exams it is the prior alone: rate 0.4, strength 2. With many exams the record decides."""
    a, b, mu, kappa = L.posterior(np.zeros(3), 0.0, None)
    assert np.allclose(mu, 0.4) and kappa == 2 and np.allclose(a / (a + b), 0.4)
    a, b, mu, _ = L.posterior(np.array([40.0, 0.0]), 40.0, None)
    assert a[0] / (a[0] + b[0]) > 0.9 > 0.1 > a[1] / (a[1] + b[1])
    # One item a unit: (h + 4 course) / (n + 4), course = (3 + 1.6) / (10 + 4).
    _, _, mu, _ = L.posterior(np.array([3.0, 0.0]), 5.0, np.array([7, 9]))
    course = (3 + 2 * 0.4 * 2) / (5 * 2 + 2 * 2)
    assert np.allclose(mu, [(3 + 4 * course) / 9, 4 * course / 9])


def test_no_member_sees_its_cutoff_or_later(spark):
    y = random_y(1)
    other = [row if t < 4 else [1 - v for v in row] for t, row in enumerate(y)]
    got = []
    for rows in (y, other):
        c, u = cells(spark, rows, True), units_of(spark, 6)
        post = B.posteriors(c, u)
        f = B.generic_features(c, u, post)
        x = f.join(B.recurrence_scores(post).groupBy("course_id", "k", "cutoff").pivot("model").agg(F.first("score")), ["course_id", "k", "cutoff"])
        past = c.where(f"t < {len(rows)}")
        timed = f.join(c.select("course_id", "k", F.col("t").alias("cutoff"), F.sum("y").over(P.before()).alias("n"), F.count("*").over(P.before()).alias("steps")), ["course_id", "k", "cutoff"])
        x = x.join(B.temporal_scores(timed, post, past).withColumnRenamed("score", "timed"), ["course_id", "k", "cutoff"]).join(L.pooled_hmm(c).withColumnRenamed("score", "hidden"), ["course_id", "k", "cutoff"])
        p = x.where("cutoff <= 4").orderBy("cutoff", "k").toPandas()
        got.append(p.drop(columns=["course_id"]).round(9))
    pd.testing.assert_frame_equal(*got)
    assert len(got[0]) == 24


def test_unit_recency_is_that_of_the_units_maximum(spark):
    c, u = cells(spark, [[1, 0, 0, 1], [0, 0, 0, 0]], True), units_of(spark, 4)
    from chronopanel.operators import features as X

    r = {(x.unit, x.cutoff): x.unit_ewma for x in X.unit_recency(c, u).where("cutoff > 0").collect()}
    half = 0.5 ** (1 / 1.5)
    assert abs(r[0, 1] - 1) < 1e-12 and abs(r[1, 2] - half / (1 + half)) < 1e-12


def test_choices_need_a_reliable_lead(spark):
    v = {"d": [0.5] * 6, "good": [0.7, 0.71, 0.69, 0.7, 0.72, 0.7], "wild": [1.0, 0.0, 1.0, 0.3, 1.0, 0.0]}
    rows = [(1, t, m, x) for m, xs in v.items() for t, x in enumerate(xs, 1)]
    folds = spark.createDataFrame(rows, "course_id long, cutoff int, model string, ndcg double")
    at = spark.createDataFrame([(1, t) for t in range(1, 8)], "course_id long, cutoff int")
    got = {r.cutoff: r.model for r in M.running_choice(folds, "ndcg", at, ["d", "good", "wild"], "d").collect()}
    assert got[1] == got[2] == "d" and got[7] == "good" and len(got) == 7
    first = {r.cutoff: r.model for r in M.running_first(folds, "ndcg", at, "d").collect()}
    assert first[1] == "d" and first[2] == "wild" and first[3] == "good"


def test_weights_sum_to_one_and_follow_skill(spark):
    rows = [(1, t, m, x) for t in range(1, 9) for m, x in (("recency", 0.8), ("markov", 0.4), ("general", 0.5))]
    folds = spark.createDataFrame(rows, "course_id long, cutoff int, model string, ndcg double")
    scored = folds.select("course_id", "cutoff", "model")
    exams = spark.createDataFrame([(1, t, 2000 + t if t != 3 else None) for t in range(9)], "course_id long, t int, year int")
    quality = spark.createDataFrame([(1, 8, "markov", 0.5)], "course_id long, cutoff int, member string, quality double")
    w = B.evidence_weights(folds, scored, exams, quality)
    x = {(r.cutoff, r.member): r for r in w.collect()}
    for t in range(1, 9):
        assert abs(sum(x[t, m].weight for m in ("recency", "markov", "general")) - 1) < 1e-9
    assert x[1, "recency"].skill == 0 and x[1, "general"].reliability == 1 and x[1, "recency"].reliability == 0.5
    assert x[8, "recency"].weight > x[8, "general"].weight > x[8, "markov"].weight and x[8, "recency"].folds == 7
    assert abs(x[8, "markov"].reliability - 0.5 * 7.5 / 9.5) < 1e-12
    ranks = spark.createDataFrame([(1, 0, 8, m, r) for m, r in (("recency", 1.0), ("general", 0.0))], "course_id long, k long, cutoff int, member string, rank double")
    doubt = spark.createDataFrame([(1, 0, 8, 1.0)], "course_id long, k long, cutoff int, variance_ratio double")
    g = {r.member: r.weight for r in B.gated_ensemble(ranks, w, doubt).collect()}
    a, b = x[8, "recency"].weight, 2 * x[8, "general"].weight
    assert abs(g["recency"] - a / (a + b)) < 1e-9


def test_general_model_leaves_a_courses_part_out(spark):
    rng = np.random.default_rng(2)
    rows = [(c, *rng.random(len(B.GENERIC)).tolist(), int(rng.random() < 0.5)) for c in range(40) for _ in range(5)]
    df = spark.createDataFrame(rows, "course_id long, " + ", ".join(f"{f} double" for f in B.GENERIC) + ", y int")
    n = len(B.GENERIC)
    prior = (np.full(n, 0.5), np.full(n, 0.3), np.zeros(n), 0.0)
    part = F.pmod(F.xxhash64("course_id"), F.lit(B.PARTS))
    flipped = df.withColumn("y", F.when(part == 2, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = B.repository_models(df, prior), B.repository_models(flipped, prior)
    assert np.allclose(a[2][0], b[2][0]) and not np.allclose(a[1][0], b[1][0])
    # The same as a fit on the rows themselves.
    p = df.where(part != 2).toPandas()
    w, c = L.map_logistic((p[B.GENERIC].to_numpy() - 0.5) / 0.3, p["y"].to_numpy(float), np.zeros(n), 0.0, B.REPOSITORY_PRECISION)
    assert np.allclose(a[2][0], w, atol=1e-5) and abs(a[2][1] - c) < 1e-5


def test_confidence_and_counting(spark):
    rows = [(0.0, "C", "auto"), (0.12, "B", "auto"), (0.22, "C", "manual"), (0.34, "B", "manual"), (0.64, "A", "auto"), (None, None, None)]
    df = spark.createDataFrame(rows, "score double, status string, method string")
    got = df.select(V.match_confidence(F.col("score")).alias("c"), V.counts_for_prediction(F.col("status"), F.col("method"), F.col("score"), 0.0).alias("n")).collect()
    assert [round(r.c, 6) if r.c is not None else None for r in got] == [0, 0.25, 0.5, 0.75, 1, None]
    assert [r.n for r in got] == [True, False, False, True, True, False]  # a manual C doesn't count even at strictness 0


@pytest.mark.parametrize(("token", "bad"), [("NPSH", False), ("LMTD", False), ("xkcdq", True), ("l0ad", True), ("H2SO4", False), ("25mm", False), ("dErIvE", True), ("McDonald", False), ("aaaab", True), ("the", False), ("rhythm", False)])
def test_implausible_tokens(spark, token, bad):
    assert spark.createDataFrame([(token,)], "x string").select(T.implausible_token(F.col("x")).alias("y")).first().y == bad


@pytest.mark.parametrize(("x", "want"), [("H₂O and x²", "H2O and x^2"), ("aₙ₂", "a_n2"), ("½ of α±β", "1/2 of alpha +/- beta"), ("5 × 10⁻³", "5 x 10^-3"), ("plain", "plain"), (None, None)])
def test_math_symbols(spark, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(T.normalize_math(F.col("x")).alias("y")).first().y == want


def test_kinds_come_up_from_below_and_units_are_roots(spark):
    f = spark.createDataFrame([(1, None, ["theory"]), (2, 1, None), (3, 2, ["numerical"]), (4, 9, ["lab"]), (5, 5, ["theory"])], "node_id long, parent_id long, kinds array<string>")
    got = {(r.node_id, r.kind) for r in trees.kinds_below(f).collect()}
    assert got == {(1, "theory"), (1, "numerical"), (2, "numerical"), (3, "numerical"), (4, "lab"), (5, "theory")}
    rows = f.select("node_id", "parent_id", F.lit(0).alias("loaded_at"))
    nodes = spark.createDataFrame([(1, 0, 3), (1, 1, 4), (1, 2, 5), (1, 3, 77)], "course_id long, k long, node_id long")
    assert {r.k: r.unit for r in trees.item_units(nodes, rows).collect()} == {0: 1, 1: 4, 2: 5, 3: 77}


def test_contexts_hold_all_stems_above(spark):
    q = spark.createDataFrame([(1, "outer stem", None), (2, " middle  one ", 1), (3, "leaf", 2), (4, None, 3), (5, "loop", 6), (6, "loop too", 5), (7, "lost", 99)], "question_id long, text string, parent_id long")
    got = {r.question_id: r.context for r in trees.context_texts(q).collect()}
    assert got[3] == "outer stem middle one leaf" and got[4] == "outer stem middle one leaf" and got[1] == "outer stem" and got[5] == "loop" and got[7] == "lost"


def _aligner(spark, questions, nodes, pairs=()):
    q = spark.createDataFrame([(1, i, t, w, 1, 1, False, 0) for i, t, ws in questions for w in ws.split()], "course_id long, question_id long, t int, term string, own int, around int, lab_cue boolean, numbers int")
    n = spark.createDataFrame([(1, i, lab, w, 1) for i, lab, ws in nodes for w in ws.split()], "course_id long, node_id long, is_lab boolean, term string, tf int")
    return A.Aligner(q, n, spark.createDataFrame(list(pairs), "ancestor_id long, node_id long"))


def test_alignment_status_second_topic_and_laboratory(spark):
    nodes = [(10, False, "steam turbine blade"), (11, False, "steam turbine rotor"), (12, True, "steam turbine blade"), (13, False, "weir flow")]
    a = _aligner(spark, [(1, 0, "steam turbine"), (2, 0, "weir flow"), (3, 0, "quark gluon"), (4, 0, "steam turbine blade")], nodes)
    got = {(r.question_id, r.rank): r for r in a.run(False).collect()}
    assert got[1, 1].node_id == 10 and got[1, 2].node_id == 11 and got[1, 1].status == "A"
    assert got[2, 1].node_id == 13 and got[2, 1].status == "A" and (2, 2) not in got
    assert got[3, 1].node_id is None and got[3, 1].status == "D"
    assert got[4, 1].node_id == 10 and got[4, 1].score > 0.9
    related = _aligner(spark, [(1, 0, "steam turbine")], nodes, [(10, 11)])
    assert [r.rank for r in related.run(False).collect()] == [1]


def test_feedback_comes_from_earlier_exams_alone(spark):
    nodes = [(10, False, "steam turbine blade"), (13, False, "weir flow crest"), (14, False, "pump head loss")]
    taught = [(i, 0, "weir flow crest loss") for i in (1, 2)]
    a = _aligner(spark, [*taught, (3, 0, "loss"), (4, 1, "loss")], nodes)
    plain = {r.question_id: (r.node_id, r.score) for r in a.run(False).collect() if r.rank == 1}
    got = {r.question_id: (r.node_id, r.score) for r in a.run().collect() if r.rank == 1}
    assert got[3] == plain[3]
    both = {r.node_id for r in a.scored(a.taught(a.confident(a.scored(a.nodes, []))), ["t"]).where("question_id = 4").collect()}
    assert both == {13, 14}  # the weir has learnt the word from the first exam


def test_steps_in_any_order(spark, tmp_path):
    for i, rows in enumerate([[(1, 2, 1)], [(1, 0, 1)], [(1, 3, 0), (1, 1, 0)], [(1, 2, 0)]]):
        spark.createDataFrame(rows, "k long, t int, y long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert i >= 0
    s = flows.item_state(flows.file_stream(spark, f"{tmp_path}/in", "k long, t int, y long", per_trigger=1))
    flows.run_to_table(s, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = flows.newest(spark.read.parquet(f"{tmp_path}/out"), "version", "k", "t")
    assert {r.t: (r.seen, r.streak, r.since) for r in got.collect()} == {0: (1, 1, 0), 1: (1, 0, 1), 2: (2, 1, 0), 3: (2, 0, 1)}


def test_upserts_are_merged_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "MERGED_AFTER", 2)
    for i in range(5):
        spark.createDataFrame([(i % 2, i, 10 * i)], "k long, t int, y long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = flows.file_stream(spark, f"{tmp_path}/in", "k long, t int, y long", per_trigger=1)
    flows.upsert_batches(s, f"{tmp_path}/up", f"{tmp_path}/ck", "k", "t")
    assert {(r.k, r.t) for r in flows.read_upserted(spark, f"{tmp_path}/up", "k", "t").collect()} == {(0, 4), (1, 3)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session())


def test_long_syllabus_headings_stay(spark):
    from chronopanel.operators import parsing

    title = "Flow of " + "very " * 80 + "thick oil"
    syl = spark.createDataFrame([(1, 1, f"1. {title}\n1.1 Losses")], "file_id long, page_no int, text string")
    got = parsing.parse_syllabus(syl).orderBy("node_no").collect()
    assert got[0].title == title and got[1].parent_no == 1
