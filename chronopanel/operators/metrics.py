"""Ranking metrics of scored items, fold tables, paired tests, and reliability of probabilities."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators.panel import average_percentile

FOLD = ("course_id", "model", "cutoff")


def with_truth(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds rel (0/1) and gain (marks over the exam's marks, or 1 over the items present where no marks are known)."""
    c = W.partitionBy("course_id", "t")
    total, present = F.sum("marks").over(c), F.sum("y").over(c)
    gain = F.when(F.col("y") == 0, 0.0).when((total > 0) & (F.col("marks") > 0), F.col("marks") / total).otherwise(1.0 / present)
    truth = cells.select("course_id", "k", F.col("t").alias("cutoff"), F.col("y").cast("int").alias("rel"), gain.alias("gain"))
    return scores.join(truth, ["course_id", "k", "cutoff"])


def fold_metrics(scored: DataFrame, top_k: DataFrame) -> DataFrame:
    """One row a fold (course, model, cutoff) whose exam holds any item: precision, recall, hit, ndcg, ndcg_marks at the
    course's top_k, mrr, average precision and hits at 1, 3, 5, 10. Folds without a relevant item have no metrics.

    Items are ranked by falling score, ties by item, in one sort a fold; the ideal orders follow from the number of relevant
    items and from their gains alone."""
    w = W.partitionBy(*FOLD).orderBy(F.desc("score"), "k")
    r = scored.select("*", F.row_number().over(w).alias("rank"), F.sum("rel").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cum"))
    disc = lambda c: 1 / F.log2(c + 1)
    r = r.join(top_k, "course_id")
    in_k = F.col("rank") <= F.col("top_k")
    sum_if = lambda v: F.sum(F.when(in_k, v).otherwise(0.0))
    out = r.groupBy(*FOLD).agg(
        F.first("top_k").alias("k_at"), F.sum("rel").alias("relevant"), sum_if(F.col("rel")).alias("hits"), sum_if(F.col("rel") * disc(F.col("rank"))).alias("dcg"),
        sum_if(F.col("gain") * disc(F.col("rank"))).alias("dcg_m"), F.sort_array(F.collect_list(F.when(F.col("gain") > 0, F.col("gain"))), False).alias("gains"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first_hit"), F.sum(F.when(F.col("rel") > 0, F.col("cum") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        *[F.max(F.when(F.col("rank") <= n, F.col("rel")).otherwise(0)).alias(f"hit_{n}") for n in (1, 3, 5, 10)],
    ).where("relevant > 0")
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    best = lambda c: F.slice(c, F.lit(1), F.col("k_at").cast("int"))
    out = out.select(
        "*", added(best(F.transform(F.sequence(F.lit(1), F.col("relevant").cast("int")), disc))).alias("idcg"),
        added(best(F.transform("gains", lambda v, i: v * disc(i + 1)))).alias("idcg_m"),
    )
    return out.select(
        *FOLD, "relevant", (F.col("hits") / F.col("k_at")).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"), (F.col("hits") > 0).cast("int").alias("hit"),
        (F.col("dcg") / F.col("idcg")).alias("ndcg"), (F.col("dcg_m") / F.col("idcg_m")).alias("ndcg_marks"), (1 / F.col("first_hit")).alias("mrr"), (F.col("ap_sum") / F.col("relevant")).alias("average_precision"),
        "hit_1", "hit_3", "hit_5", "hit_10",
    )


def random_expectations(cells: DataFrame, top_k: DataFrame) -> DataFrame:
    """course_id, cutoff, precision, hit expected of a random order: K items drawn of n, m of them relevant."""
    x = cells.groupBy("course_id", F.col("t").alias("cutoff")).agg(F.count("*").alias("n"), F.sum("y").alias("m")).join(top_k, "course_id").where("m > 0")
    draws = F.sequence(F.lit(0), (F.least("top_k", "n") - 1).cast("int"))
    miss = F.aggregate(draws, F.lit(1.0), lambda acc, i: acc * F.greatest(F.col("n") - F.col("m") - i, F.lit(0)) / (F.col("n") - i))
    return x.select("course_id", "cutoff", (F.col("m") / F.col("n")).alias("precision"), (1 - miss).alias("hit"))


def mean_and_se(folds: DataFrame, metric: str, *keys: str) -> DataFrame:
    """keys, n, mean, se (of a sample; null for one fold) of a metric."""
    return folds.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count("*"))).alias("se"))


def paired(folds: DataFrame, metric: str, against: str) -> DataFrame:
    """model, n, mean_diff, se, better, worse against another model on the same folds."""
    other = folds.where(F.col("model") == against).select("course_id", "cutoff", F.col(metric).alias("_o"))
    x = folds.where(F.col("model") != against).join(other, ["course_id", "cutoff"]).withColumn("d", F.col(metric) - F.col("_o"))
    return x.groupBy("model").agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_diff"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"),
        F.count(F.when(F.col("d") > 1e-9, 1)).alias("better"), F.count(F.when(F.col("d") < -1e-9, 1)).alias("worse"),
    )


@cache
def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution (regularised incomplete beta)."""
    from chronopanel.functions.numerics import beta_cdf

    if df < 1:
        return math.inf
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - beta_cdf(df / (df + mid * mid), df / 2, 0.5) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_bound(n: Column, p: float = 0.95, most: int = 200) -> Column:
    """One-sided t quantile for samples of size n, as a lookup; null (nothing is significant) below two."""
    table = F.array(*[F.lit(t_quantile(p, i)) for i in range(1, most)])
    return F.when(n >= 2, F.element_at(table, F.least(n - 1, F.lit(most - 1)).cast("int")))


def select_by_one_se(folds: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """model, mean, chosen: the simplest (first in order) model within one standard error of the best mean."""
    s = mean_and_se(folds, metric, "model")
    best = F.max(F.struct("mean", "model", "se")).over(W.partitionBy(F.lit(0)))  # a row a model
    simple = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    x = s.withColumn("_b", best).where(F.col("mean") >= F.col("_b.mean") - F.coalesce("_b.se", F.lit(0.0))).withColumn("simple", simple)
    return x.orderBy("simple").limit(1).select("model", "mean")


def running_best(folds: DataFrame, metric: str) -> DataFrame:
    """course_id, cutoff, model, score: the model with the best mean on the folds before each cutoff; ties by name."""
    cut = folds.select("course_id", F.col("cutoff").alias("target")).distinct()
    past = folds.join(cut, "course_id").where("cutoff < target").groupBy("course_id", "target", "model").agg(F.avg(metric).alias("m"))
    rank = F.row_number().over(W.partitionBy("course_id", "target").orderBy(F.desc("m"), "model"))
    return past.withColumn("r", rank).where("r = 1").select("course_id", F.col("target").alias("cutoff"), "model", F.col("m").alias("score"))


def tuned_choice(folds: DataFrame, metric: str, variants: list[str], default: str) -> DataFrame:
    """course_id, cutoff, model: the best variant on earlier folds, only if it beats the default beyond the one-sided t bound."""
    d = folds.where(F.col("model") == default).select("course_id", "cutoff", F.col(metric).alias("_d"))
    diff = folds.where(F.col("model").isin(*[v for v in variants if v != default])).join(d, ["course_id", "cutoff"]).withColumn("diff", F.col(metric) - F.col("_d"))
    cut = folds.select("course_id", F.col("cutoff").alias("target")).distinct()
    past = diff.join(cut, "course_id").where("cutoff < target").groupBy("course_id", "target", "model").agg(F.avg("diff").alias("m"), F.stddev_samp("diff").alias("s"), F.count("*").alias("n"))
    good = past.where(F.col("m") > t_bound(F.col("n")) * F.col("s") / F.sqrt("n"))
    best = good.groupBy("course_id", "target").agg(F.max_by("model", F.struct("m", "model")).alias("model"))
    return cut.join(best, ["course_id", "target"], "left").select("course_id", F.col("target").alias("cutoff"), F.coalesce("model", F.lit(default)).alias("model"))


def running_choice(folds: DataFrame, metric: str, at: DataFrame, variants: list[str], default: str) -> DataFrame:
    """course_id, cutoff, model at every cutoff of at: the variant with the best mean on earlier folds, if it beats the
    default beyond the one-sided t bound; else the default. Ties go to the first variant. One running window a variant."""
    d = folds.where(F.col("model") == default).select("course_id", "cutoff", F.col(metric).alias("_d"))
    diff = folds.where(F.col("model").isin(*[v for v in variants if v != default])).join(d, ["course_id", "cutoff"]).select("course_id", "cutoff", "model", (F.col(metric) - F.col("_d")).alias("diff"))
    grid = at.select("course_id", "cutoff", F.explode(F.array(*[F.lit(v) for v in variants if v != default])).alias("model")).join(diff, ["course_id", "cutoff", "model"], "left")
    w = W.partitionBy("course_id", "model").orderBy("cutoff").rowsBetween(W.unboundedPreceding, -1)
    x = grid.select("course_id", "cutoff", "model", F.avg("diff").over(w).alias("m"), F.stddev_samp("diff").over(w).alias("s"), F.count("diff").over(w).alias("n"))
    place = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("model"))
    best = x.groupBy("course_id", "cutoff").agg(F.max(F.struct(F.round(F.coalesce("m", F.lit(-9.0)), 12).alias("m"), (-place).alias("p"), "model", "s", "n")).alias("b"))
    good = (F.col("b.m") > 1e-12) & (F.col("b.n") >= 2) & (F.col("b.m") > t_bound(F.col("b.n")) * F.col("b.s") / F.sqrt("b.n"))
    return best.select("course_id", "cutoff", F.when(F.coalesce(good, F.lit(False)), F.col("b.model")).otherwise(default).alias("model"))


def running_first(folds: DataFrame, metric: str, at: DataFrame, default: str) -> DataFrame:
    """course_id, cutoff, model at every cutoff of at: the model with the best mean on earlier folds, the default before any;
    ties by name."""
    models = folds.select("course_id", "model").distinct()
    grid = at.join(models, "course_id").join(folds.select("course_id", "cutoff", "model", F.col(metric).alias("v")), ["course_id", "cutoff", "model"], "left")
    w = W.partitionBy("course_id", "model").orderBy("cutoff").rowsBetween(W.unboundedPreceding, -1)
    x = grid.select("course_id", "cutoff", "model", F.round(F.avg("v").over(w), 12).alias("m"))
    best = x.where("m is not null").withColumn("r", F.row_number().over(W.partitionBy("course_id", "cutoff").orderBy(F.desc("m"), "model"))).where("r = 1").select("course_id", "cutoff", "model")
    return at.join(best, ["course_id", "cutoff"], "left").select("course_id", "cutoff", F.coalesce("model", F.lit(default)).alias("model"))


def ensemble_weights(folds: DataFrame, metric: str, components: dict[str, float], baseline: str, tau: float = 2.0, shrink: float = 3.0) -> DataFrame:
    """course_id, cutoff, model, weight: reliability times the exponential of the shrunken skill on earlier folds.

    components: degrees of freedom a component; reliability is E / (E + df) of the E exams before the cutoff (1 for none).
    skill: mean gain over the baseline by its deviation, times n / (n + shrink); 0 without two folds or deviation.
    """
    cut = folds.select("course_id", F.col("cutoff").alias("target")).distinct()
    base = folds.where(F.col("model") == baseline).select("course_id", "cutoff", F.col(metric).alias("_b"))
    mine = folds.where(F.col("model").isin(*components)).join(base, ["course_id", "cutoff"]).withColumn("g", F.col(metric) - F.col("_b"))
    past = mine.join(cut, "course_id").where("cutoff < target").groupBy("course_id", "target", "model").agg(F.avg("g").alias("m"), F.stddev_samp("g").alias("s"), F.count("*").alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(df)).alias("df")) for m, df in sorted(components.items())]))
    every = cut.select("course_id", "target", one.alias("_c")).select("course_id", "target", "_c.model", "_c.df")
    x = every.join(past, ["course_id", "target", "model"], "left")
    skill = F.when((F.col("n") >= 2) & (F.col("s") > 0), F.col("m") / F.col("s") * F.col("n") / (F.col("n") + shrink)).otherwise(0.0)
    rho = F.when(F.col("df") == 0, 1.0).otherwise(F.col("target") / (F.col("target") + F.col("df")))
    return x.select("course_id", F.col("target").alias("cutoff"), "model", (rho * F.exp(tau * F.greatest(F.least(skill, F.lit(2.0)), F.lit(-2.0)))).alias("weight"))


def ensemble_scores(long: DataFrame, weights: DataFrame) -> DataFrame:
    """course_id, k, cutoff, model (`ensemble`), score: weighted mean of the components' percentile ranks."""
    p = long.join(weights, ["course_id", "cutoff", "model"]).withColumn("p", average_percentile(F.col("score"), "course_id", "cutoff", "model"))
    return p.groupBy("course_id", "k", "cutoff").agg((F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("score")).select("course_id", "k", "cutoff", F.lit("ensemble").alias("model"), "score")


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def log_loss(p: str = "p", y: str = "y") -> Column:
    c = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(-(F.col(y) * F.ln(c) + (1 - F.col(y)) * F.ln(1 - c)))


def reliability(preds: DataFrame, bins: int = 10, order: str = "k") -> DataFrame:
    """model, bin, n, mean_p, rate: equal-count bins by probability; the larger ones come first."""
    b = F.ntile(bins).over(W.partitionBy("model").orderBy("p", "course_id", "cutoff", order))
    return preds.withColumn("bin", b).groupBy("model", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def benjamini_hochberg(df: DataFrame, p: str, tie: list[str], *keys: str) -> DataFrame:
    """Adds q, the step-up adjusted p values in a group."""
    n, rank = F.count("*").over(W.partitionBy(*keys)), F.row_number().over(W.partitionBy(*keys).orderBy(p, *tie))
    x = df.withColumn("_q", F.col(p) * n / rank).withColumn("_r", rank)
    down = W.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn("q", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_q", "_r")
