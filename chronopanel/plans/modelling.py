"""Queries of the iterative models."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import metrics as M
from chronopanel.operators import models as L
from chronopanel.plans.forecasts import _H, _history, features, simple_scores
from chronopanel.plans.panels import PANEL, UNITS, cells, rounded, units
from chronopanel.sources.tables import cut


def _scored(spark, d, model="bayes"):
    return simple_scores(spark, d).where(F.col("model") == model).join(cells(spark, d).select("course_id", "k", F.col("t").alias("cutoff"), F.col("y").cast("double").alias("y")), ["course_id", "k", "cutoff"])


def _calibrated(spark, d, method):
    c = cut(L.calibrate(_scored(spark, d), method))
    return rounded(c.groupBy("cutoff").agg(F.count("*").alias("n"), M.brier().alias("brier"), M.log_loss().alias("log_loss"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate")))


QUERIES = {
    "fit_recurrence": lambda s, d: rounded(L.fit_recurrence(L.weighted_counts(cells(s, d, True), units(s, d)))),
    "fit_recurrence_decay": lambda s, d: rounded(L.fit_recurrence(L.weighted_counts(cells(s, d, True), units(s, d), 3.0), ("3",))),
    "weighted_counts": lambda s, d: rounded(L.weighted_counts(cells(s, d, True), units(s, d), 3.0)),
    "bayes_fixed_kappa": lambda s, d: rounded(_history(s, d).select("course_id", "k", "cutoff", "bayes_mean")),
    "pooled_hmm": lambda s, d: rounded(L.pooled_hmm(cells(s, d, True))),
    "forest_scores": lambda s, d: rounded(L.tree_scores(features(s, d), cells(s, d))),
    "boosted_scores": lambda s, d: rounded(L.tree_scores(features(s, d), cells(s, d), "boosted")),
    "calibrate_platt": lambda s, d: _calibrated(s, d, "platt"),
    "calibrate_isotonic": lambda s, d: _calibrated(s, d, "isotonic"),
    "simulated_panels": lambda s, d: L.simulate_courses(s, 40).groupBy("course_id", "k", "unit").agg(F.sum("y").alias("n"), F.count("*").alias("steps")),
}
_HW = _H.replace(PANEL, UNITS).replace("hf AS", "w3 AS (SELECT course_id, k, cutoff, any_value(unit) AS unit, sum(y * pow(0.5, (cutoff - 1 - t) / 3.0)) AS h, sum(pow(0.5, (cutoff - 1 - t) / 3.0)) AS n FROM hist JOIN un USING (course_id, k) GROUP BY course_id, k, cutoff), hf AS", 1)
ORACLES = {
    "weighted_counts": _HW + "SELECT course_id, k, cutoff, '3' AS variant, unit, round(h + 1e-10, 6) AS h, round(n + 1e-10, 6) AS n FROM w3",
    "bayes_fixed_kappa": _H + "SELECT course_id, k, cutoff, round(bayes_mean + 1e-10, 6) AS bayes_mean FROM hf",
}
