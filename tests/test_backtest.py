"""The walk through a course against the same steps as DataFrames."""

import numpy as np
from pyspark.sql import functions as F

from chronopanel.operators import backtest as K
from chronopanel.operators import members as B
from chronopanel.operators import metrics as M


def test_walk_is_the_data_frames_steps(spark):
    rng = np.random.default_rng(5)
    names = ["recency", "markov", "general", "coverage"]
    cell = [(c, k, t, int(rng.random() < 0.4)) for c in (1, 2) for t in range(7) for k in range(6)]
    past = spark.createDataFrame(cell, "course_id long, k long, t int, y long")
    ratio = spark.createDataFrame([(c, k, t, float(rng.random())) for c in (1, 2) for t in range(1, 8) for k in range(6)], "course_id long, k long, cutoff int, variance_ratio double")
    scores = spark.createDataFrame([(c, k, t, m, float(rng.integers(0, 4))) for c in (1, 2) for t in range(1, 8) for k in range(6) for m in names if (m, t) != ("markov", 1)], "course_id long, k long, cutoff int, model string, score double")
    top = spark.createDataFrame([(1, 3), (2, 3)], "course_id long, top_k long")
    exams = spark.createDataFrame([(c, t, None if t == 2 else 2000 + t) for c in (1, 2) for t in range(7)], "course_id long, t int, year int")
    quality = scores.select("course_id", "cutoff", F.col("model").alias("member"), F.lit(0.8).alias("quality")).distinct()
    x = K.walk(scores.unionByName(K.facts(past, ratio, top, exams, quality)), {}, names, ("fold", "weight", "share", "score", "ablation")).cache()
    folds = M.fold_metrics(M.with_truth(scores, past.withColumn("marks", F.lit(0.0))), top)
    near = lambda a, b: a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-9)
    key = lambda df, *cols: {tuple(r[:-1]): r[-1] for r in df.select(*cols).collect()}
    assert near(key(x.where("what = 'fold' and model not in ('ensemble', 'best_single')"), "course_id", "cutoff", "model", "a"), key(folds, "course_id", "cutoff", "model", "ndcg"))
    weights = B.evidence_weights(folds, scores, exams, quality)
    assert near(key(x.where("what = 'weight'"), "course_id", "cutoff", "model", "c"), key(weights, "course_id", "cutoff", "member", "weight"))
    ranks = scores.select("course_id", "k", "cutoff", F.col("model").alias("member"), B.X.average_percentile(F.col("score"), "course_id", "cutoff", "model").alias("rank"))
    shares = B.gated_ensemble(ranks, weights, ratio)
    assert near(key(x.where("what = 'share'"), "course_id", "k", "cutoff", "model", "c"), key(shares, "course_id", "k", "cutoff", "member", "share"))
    at = ratio.select("course_id", "cutoff").distinct()
    chosen = M.running_first(folds, "ndcg", at, "beta_binomial").join(scores, ["course_id", "cutoff", "model"])
    assert near(key(x.where("what = 'score' and model = 'best_single'"), "course_id", "k", "cutoff", "a"), key(chosen, "course_id", "k", "cutoff", "score"))
    stage = shares.where("member <> 'general'").groupBy("course_id", "k", "cutoff").agg((F.sum("share") / F.sum("weight")).alias("score")).withColumn("model", F.lit("m"))
    left = M.fold_metrics(M.with_truth(stage.withColumn("score", F.round("score", 12)), past.withColumn("marks", F.lit(0.0))), top)
    assert near(key(x.where("what = 'ablation' and model = 'without_general'"), "course_id", "cutoff", "a"), key(left, "course_id", "cutoff", "ndcg"))


def test_courses_without_folds_give_no_rows(spark):
    """No exam holds an item: there is nothing to measure, and the walk of select_final ends without a row."""
    scores = spark.createDataFrame([(c, k, t, "recency", 0.5) for c in (1, 2) for t in (1, 2) for k in (1, 2)], "course_id long, k long, cutoff int, model string, score double")
    past = scores.select("course_id", "k", (F.col("cutoff") - 1).alias("t"), F.lit(0).cast("long").alias("y"))
    ratio, top = scores.select("course_id", "k", "cutoff", F.lit(1.0).alias("variance_ratio")), spark.createDataFrame([], "course_id long, top_k long")
    exams, quality = past.select("course_id", "t", F.lit(2000).alias("year")).distinct(), scores.select("course_id", "cutoff", F.col("model").alias("member"), F.lit(0.8).alias("quality")).distinct()
    assert K.walk(scores.unionByName(K.facts(past, ratio, top, exams, quality)), {}, ["recency"], ("fold",)).collect() == []
