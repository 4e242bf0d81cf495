"""The features of every item at every cutoff, from the steps before it.

All history is a window frame that ends before the cutoff's row, so no feature can see the cutoff or later steps. Course
statistics at a cutoff (hazards, pooled transitions, lifts) come from tables of a few rows a step, joined with the
cutoffs after them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators.dynamics import MAX_GAP, ewma, since_last, with_position
from chronopanel.operators.models import in_groups
from chronopanel.operators.panel import FORMATS, average_percentile, before, last
from chronopanel.operators.trees import item_nodes
from chronopanel.sources.tables import cut

H_SHORT, H_LONG = 1.5, 6.0
#: Strength of the prior of the recurrence rate, and of the pooled transitions.
KAPPA, MARKOV = 4.0, 2.0


def unit_recency(cells: DataFrame, units: DataFrame) -> DataFrame:
    """course_id, unit, cutoff, unit_ewma: short ewma of whether any item of the unit appeared. units: course_id, k, unit."""
    per = cells.select("course_id", "k", "t", "y").join(units, ["course_id", "k"]).groupBy("course_id", "unit", "t").agg(F.max("y").alias("y"))
    w = F.pow(F.lit(2.0), F.col("t") / F.lit(H_SHORT))
    b = before("t", "course_id", "unit")
    return per.select("course_id", "unit", F.col("t").alias("cutoff"), (F.sum(F.col("y") * w).over(b) / F.sum(w).over(b)).alias("unit_ewma"))


def history_features(cells: DataFrame) -> DataFrame:
    """Frequency, recency, semantic, quality, marks and recurrence features; cells have the step to forecast, too."""
    w = before()
    x = with_position(cells).withColumn("share", F.col("marks") / F.greatest(F.sum("marks").over(W.partitionBy("course_id", "t")), F.lit(1e-9)))
    x = x.withColumn("shown", F.when(F.col("y") > 0, F.col("share")))
    n, steps = F.sum("y").over(w), F.count("*").over(w)
    q = F.sum("n_questions").over(w)
    rate = lambda c: F.when(q > 0, F.sum(c).over(w) / q).otherwise(0.0)
    out = x.select(
        "course_id", "k", F.col("t").alias("cutoff"), n.alias("n"), steps.alias("steps"), (n / steps).alias("freq_all"), F.log1p(n).alias("count_log"),
        F.avg("y").over(last(1)).alias("last1"), F.avg("y").over(last(2)).alias("last2"), F.avg("y").over(last(3)).alias("freq_last3"), F.avg("y").over(last(5)).alias("freq_last5"),
        ewma("y", H_SHORT).alias("ewma_short"), ewma("y", H_LONG).alias("ewma_long"), *[ewma("y", h).alias(f"ewma_{str(h).replace('.', '_')}") for h in (0.75, 2.0, 3.0)],
        (F.sum(F.col("y") * F.col("_n")).over(w) / F.sum("_n").over(w)).alias("linear_decay"),
        ewma("soft", H_LONG).alias("soft_ewma"), F.avg("soft").over(w).alias("soft_mean"), ewma("semantic", H_LONG).alias("sem_ewma"),
        F.avg((F.col("semantic") >= 0.2).cast("int")).over(w).alias("sem_density"), F.log1p(steps).alias("hist_log"),
        rate("map_conf_sum").alias("map_conf"), rate("parse_conf_sum").alias("parse_conf"), rate("marks_known_sum").alias("marks_known"), rate("optional_sum").alias("optional_rate"),
        F.coalesce(F.avg("shown").over(w), F.lit(0.0)).alias("marks_share"), ewma("share", H_SHORT).alias("marks_share_recent"),
        F.coalesce(F.avg((F.col("shown") >= 0.1).cast("int")).over(w), F.lit(0.0)).alias("high_mark_rate"), rate("exact_repeat").alias("exact_repeat_rate"), rate("para_repeat").alias("para_repeat_rate"),
    )
    base = F.sum("n").over(W.partitionBy("course_id", "cutoff")) / F.sum("steps").over(W.partitionBy("course_id", "cutoff"))
    mu = F.coalesce(base, F.lit(0.0))
    a, b = F.col("n") + KAPPA * mu, F.col("steps") - F.col("n") + KAPPA * (1 - mu)
    out = out.withColumn("base_rate", base)
    return out.withColumn("bayes_mean", a / (a + b)).withColumn("bayes_width", 2 * 1.2816 * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def timing_features(cells: DataFrame) -> DataFrame:
    """since_last, never_seen, streaks, gaps, due_z, hazard, markov_next and trend at every cutoff."""
    w = before()
    one, nil = F.max(F.when(F.col("y") > 0, F.col("t"))).over(w), F.max(F.when(F.col("y") == 0, F.col("t"))).over(w)
    prev = F.lag("y").over(W.partitionBy("course_id", "k").orderBy("t"))
    x = cells.select("course_id", "k", "t", "y", one.alias("one"), nil.alias("nil"), prev.alias("p"), since_last().alias("since"))
    x = x.withColumn("gap_now", F.when(F.col("y") > 0, F.col("t") - F.col("one")))
    tr = lambda a, b: F.sum(F.when((F.col("p") == a) & (F.col("y") == b), 1).otherwise(0)).over(w).alias(f"n{a}{b}")
    x = x.select(
        "*", F.avg("gap_now").over(w).alias("mg0"), F.stddev_samp("gap_now").over(w).alias("sd0"), F.count("gap_now").over(w).alias("n_gaps"), F.sum("y").over(w).alias("n"),
        F.count("*").over(w).alias("steps"), tr(0, 0), tr(0, 1), tr(1, 0), tr(1, 1), F.regr_slope("y", F.col("t").cast("double")).over(last(6)).alias("slope"), F.count("*").over(last(6)).alias("m6"),
    )
    c = W.partitionBy("course_id", "t")
    pool = F.coalesce(F.avg("mg0").over(c), F.greatest(F.col("steps") / 2, F.lit(1.0)))
    mg = F.coalesce("mg0", F.when(F.col("n") > 0, F.col("steps") / F.col("n")), pool)
    sd = F.coalesce("sd0", mg)
    nxt = F.when(F.col("n") > 0, F.col("since")).otherwise(F.col("steps") + 1)
    clip = lambda v, a, b: F.least(F.greatest(v, F.lit(a)), F.lit(b))
    pooled = lambda a: (F.sum(f"n{a}1").over(c) + 1e-9) / (F.sum(f"n{a}0").over(c) + F.sum(f"n{a}1").over(c) + 2e-9)
    was = F.coalesce("p", F.lit(0))
    markov = F.when(was > 0, (F.col("n11") + MARKOV * pooled(1)) / (F.col("n10") + F.col("n11") + MARKOV)).otherwise((F.col("n01") + MARKOV * pooled(0)) / (F.col("n00") + F.col("n01") + MARKOV))
    o, z = F.coalesce("one", F.lit(-1)), F.coalesce("nil", F.lit(-1))
    out = x.select(
        "course_id", "k", F.col("t").alias("cutoff"), (F.least("since", F.lit(10)) / 10).alias("since_last"), (F.col("n") == 0).cast("double").alias("never_seen"),
        F.when(o > z, F.least(F.col("t") - 1 - z, F.lit(6)) / 6).otherwise(0.0).alias("streak_present"), F.when(z > o, F.least(F.col("t") - 1 - o, F.lit(10)) / 10).otherwise(0.0).alias("streak_absent"),
        (F.least(mg, F.lit(10.0)) / 10).alias("mean_gap"), clip(sd / mg, 0.0, 3.0).alias("gap_cv"), clip((nxt - mg) / (sd + 1), -3.0, 3.0).alias("due_z"), markov.alias("markov_next"),
        F.when(F.col("m6") >= 3, clip(F.coalesce("slope", F.lit(0.0)), -0.5, 0.5)).otherwise(0.0).alias("trend"),
        F.when(F.col("n") > 0, F.least("since", F.lit(MAX_GAP))).otherwise(0).cast("long").alias("gap"),
    )
    return out.join(_hazards(cells), ["course_id", "cutoff", "gap"], "left").join(_bases(cells), ["course_id", "cutoff"], "left").withColumn("hazard", F.coalesce("rate", "base", F.lit(0.0))).drop("rate", "base", "gap")


def _bases(cells: DataFrame) -> DataFrame:
    per = cells.groupBy("course_id", "t").agg(F.sum("y").alias("s"), F.count("*").alias("c"))
    w = W.partitionBy("course_id").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    return per.select("course_id", F.col("t").alias("cutoff"), (F.sum("s").over(w) / F.sum("c").over(w)).alias("base"))


def _hazards(cells: DataFrame, strength: float = 3.0) -> DataFrame:
    """course_id, cutoff, gap, rate from the steps before the cutoff."""
    seen = F.max(F.when(F.col("y") > 0, F.col("t"))).over(before())
    at = cells.withColumn("gap", F.coalesce(F.least(F.col("t") - seen, F.lit(MAX_GAP)), F.lit(0)).cast("long")).where("t > 0")
    per = at.groupBy("course_id", "gap", "t").agg(F.sum("y").alias("hits"), F.count("*").alias("opps"))
    cut = cells.select("course_id", F.col("t").alias("cutoff")).distinct()
    run = per.join(cut, "course_id").where("t < cutoff").groupBy("course_id", "cutoff", "gap").agg(F.sum("hits").alias("hits"), F.sum("opps").alias("opps"))
    return run.join(_bases(cells), ["course_id", "cutoff"]).select("course_id", "cutoff", "gap", ((F.col("hits") + strength * F.col("base")) / (F.col("opps") + strength)).alias("rate"))


def type_features(cells: DataFrame, formats: DataFrame) -> DataFrame:
    """numerical_share, derivation_share, theory_share (with definitions) and type_entropy of the questions so far."""
    w = before()
    x = cells.select("course_id", "k", "t").join(formats, ["course_id", "t", "k"], "left").select("course_id", "k", "t", *[F.coalesce(f, F.lit(0)).alias(f) for f in FORMATS])
    x = x.select("course_id", "k", F.col("t").alias("cutoff"), *[F.coalesce(F.sum(f).over(w), F.lit(0)).alias(f) for f in FORMATS])
    total = sum((F.col(f) for f in FORMATS), F.lit(0))
    share = lambda *fs: F.when(total > 0, sum((F.col(f) for f in fs), F.lit(0)) / total).otherwise(0.0)
    entropy = sum((F.when(F.col(f) > 0, -share(f) * F.ln(share(f))).otherwise(0.0) for f in FORMATS), F.lit(0.0)) / F.ln(F.lit(7.0))
    return x.select("course_id", "k", "cutoff", share("numerical").alias("numerical_share"), share("derivation").alias("derivation_share"), share("theory", "definition").alias("theory_share"), entropy.alias("type_entropy"))


def cooccurrence_feature(cells: DataFrame, strength: float = 2.0) -> DataFrame:
    """course_id, k, cutoff, cooc_lift_last: log of the mean lift from the items of the last exam to k, by what followed
    what before the cutoff. Pairs that never followed each other enter through sums over the last exam's items."""

    def lifts(y: np.ndarray, base: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """The feature at every step. y, base: steps by items; beside: whether a step is the one after the row before."""
        follow, out = np.zeros((y.shape[1], y.shape[1])), np.zeros(y.shape)
        earlier = np.cumsum(y, 0) - y
        for i in range(1, len(y)):
            last = np.flatnonzero(y[i - 1])
            if i > 1 and beside[i - 1]:
                follow[np.ix_(np.flatnonzero(y[i - 2]), last)] += 1
            if beside[i] and len(last):
                each = 1 / (earlier[i - 1][last] + strength)
                out[i] = np.log(np.maximum((each @ follow[last] + base[i] * (strength * each.sum())) / len(last) / (base[i] + 1e-6), 1e-3))
        return out

    def fit(x: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        score = np.empty(len(x))
        start = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        for a, b in zip(start[:-1], start[1:], strict=True):
            g = x.iloc[a:b]
            (steps, at), (_, item) = np.unique(g["cutoff"], return_inverse=True), np.unique(g["k"], return_inverse=True)
            y, base = np.zeros((2, len(steps), item.max() + 1))
            np.maximum.at(y, (at, item), g["y"].to_numpy() > 0)
            base[at, item] = g["base"].fillna(0.0)
            score[a:b] = lifts(y, base, np.diff(steps, prepend=steps[0]) == 1)[at, item]
        return pd.DataFrame({"course_id": x["course_id"], "k": x["k"], "cutoff": x["cutoff"], "cooc_lift_last": score})

    rows = cells.select("course_id", "k", F.col("t").alias("cutoff"), "y", F.avg("y").over(before()).alias("base"))
    return in_groups(rows, ("course_id",), fit, "course_id long, k long, cutoff int, cooc_lift_last double")


def item_statics(mappings: DataFrame, obs: DataFrame, nodes: DataFrame) -> DataFrame:
    """course_id, k, title, hours_share, marks_weight_share, breadth of each item, by the least node that it is mapped to.

    Unknown hours and weights take the mean of the known ones if at least half are known, else all are 0; shares are
    scaled by a tenth of the number of items."""
    x = item_nodes(mappings, obs).join(nodes.select("node_id", "title", "hours", "marks_weight", "concepts"), "node_id", "left")
    c = W.partitionBy("course_id")
    size = F.count("*").over(c)

    def share(col: str) -> Column:
        known = F.count(col).over(c)
        filled = F.when(known * 2 >= size, F.coalesce(F.col(col), F.avg(col).over(c))).otherwise(0.0)
        return filled

    x = x.withColumn("h", share("hours")).withColumn("m", share("marks_weight")).withColumn("size", size)
    part = lambda v: F.when(F.sum(v).over(c) > 0, F.col(v) / F.sum(v).over(c) * F.col("size") / 10).otherwise(0.0)
    return x.select("course_id", "k", "node_id", "title", part("h").alias("hours_share"), part("m").alias("marks_weight_share"), F.log1p(F.coalesce(F.size("concepts"), F.lit(0))).alias("breadth"))


def item_similarity(statics: DataFrame) -> DataFrame:
    """course_id, k1, k2, sim (k1 <> k2): Jaccard similarity of the words of two items' titles; only pairs that share one.

    Pairs are found by an equi-join on course and word."""
    w = statics.select("course_id", "k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    n = w.groupBy("course_id", "k").agg(F.count("*").alias("n"))
    both = w.select("course_id", F.col("k").alias("k1"), "w").join(w.select("course_id", F.col("k").alias("k2"), "w"), ["course_id", "w"]).where("k1 <> k2").groupBy("course_id", "k1", "k2").agg(F.count("*").alias("b"))
    x = both.join(n.select("course_id", F.col("k").alias("k1"), F.col("n").alias("n1")), ["course_id", "k1"]).join(n.select("course_id", F.col("k").alias("k2"), F.col("n").alias("n2")), ["course_id", "k2"])
    return x.select("course_id", "k1", "k2", (F.col("b") / (F.col("n1") + F.col("n2") - F.col("b"))).alias("sim"))


def neighbour_features(history: DataFrame, sim: DataFrame) -> DataFrame:
    """sem_neighbors (similar items' short ewma, by similarity) and centrality (row mean of the similarities) of items that
    have similar ones."""
    rows = history.groupBy("course_id", "k").agg(F.sort_array(F.collect_list(F.struct("cutoff", "ewma_short"))).alias("h"))
    near = sim.groupBy("course_id", F.col("k1").alias("k")).agg(F.collect_list("k2").alias("near"), F.collect_list("sim").alias("sim"))
    x = rows.join(near, ["course_id", "k"], "left").select("course_id", "k", F.col("h.cutoff").alias("at"), F.col("h.ewma_short").alias("e"), F.coalesce("near", F.array().cast("array<bigint>")).alias("near"), F.coalesce("sim", F.array().cast("array<double>")).alias("sim"))

    def of_course(g: pd.DataFrame) -> pd.DataFrame:
        k, cutoffs = g["k"].to_numpy(), np.unique(np.concatenate(g["at"].to_numpy()))
        place = {v: i for i, v in enumerate(k)}
        e, there, sims = np.full((len(k), len(cutoffs)), np.nan), np.zeros((len(k), len(cutoffs))), np.zeros((len(k), len(k)))
        for i, (at, v, near, s) in enumerate(zip(g["at"], g["e"], g["near"], g["sim"], strict=True)):
            cell = np.searchsorted(cutoffs, at)
            e[i, cell], there[i, cell] = v, 1
            pairs = [(place[j], w) for j, w in zip(near, s, strict=True) if j in place]
            if pairs:
                sims[i, [j for j, _ in pairs]] = [w for _, w in pairs]
        total = sims @ there
        mean = np.where(sims @ ~np.isnan(e) > 0, sims @ np.nan_to_num(e) / np.maximum(total, 1e-300), np.nan)
        i, c = np.nonzero((there > 0) & (total > 0))
        return pd.DataFrame({"course_id": g["course_id"].iloc[0], "k": k[i], "cutoff": cutoffs[c], "sem_neighbors": mean[i, c], "centrality": total[i, c] / len(k)})

    def fit(x: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        start = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        return pd.concat([of_course(x.iloc[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)])

    return in_groups(x, ("course_id",), fit, "course_id long, k long, cutoff int, sem_neighbors double, centrality double")


def all_features(cells: DataFrame, formats: DataFrame, statics: DataFrame, sim: DataFrame, units: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Every feature of every item at cutoffs from 1 on; cells must hold the step to forecast. Each kind of features is written
    by a plan of its own; made gets those tables, for drop_cut() once the result is written."""
    on = ["course_id", "k", "cutoff"]
    h = cut(history_features(cells).where("cutoff > 0"))
    timing, types, pairs, near = [cut(x) for x in (timing_features(cells), type_features(cells, formats), cooccurrence_feature(cells), neighbour_features(h, sim))]
    if made is not None:
        made += [h, timing, types, pairs, near]
    x = h.join(timing, on).join(types, on).join(pairs, on).join(near, on, "left")
    x = x.join(statics.select("course_id", "k", "hours_share", "marks_weight_share", "breadth"), ["course_id", "k"], "left")
    x = x.join(units, ["course_id", "k"]).join(unit_recency(cells, units), ["course_id", "unit", "cutoff"], "left")
    return x.na.fill(0.0, ["sem_neighbors", "centrality", "hours_share", "marks_weight_share", "breadth"])


def scores(features: DataFrame) -> DataFrame:
    """course_id, k, cutoff and one score for each of the models that are an expression of the features."""
    f = F.col
    p = lambda c: average_percentile(F.round(c, 12), "course_id", "cutoff")
    return features.select(
        "course_id", "k", "cutoff", (f("freq_all") + 1e-3 * f("ewma_short")).alias("frequency"), (f("last1") + 0.1 * f("freq_all")).alias("last_exam"),
        *[(f(c) + 1e-3 * f("freq_all")).alias(n) for n, c in (("window1", "last1"), ("window2", "last2"), ("window3", "freq_last3"), ("window5", "freq_last5"))],
        *[(f(c) + 1e-4 * f("freq_all")).alias(n) for n, c in (("ewma_075", "ewma_0_75"), ("ewma_15", "ewma_short"), ("ewma_2", "ewma_2_0"), ("ewma_3", "ewma_3_0"), ("ewma_6", "ewma_long"))],
        f("linear_decay").alias("linear_decay"), ((p("freq_all") + p("ewma_short")) / 2).alias("freq_recency"), (f("markov_next") + 1e-3 * f("ewma_short")).alias("markov"),
        (0.6 * p("sem_ewma") + 0.2 * p("soft_ewma") + 0.2 * p("sem_neighbors") + 1e-6 * f("sem_ewma")).alias("semantic"), (f("cooc_lift_last") + 1e-3 * f("ewma_short")).alias("cooccurrence"),
    )


def long_scores(wide: DataFrame, models: list[str]) -> DataFrame:
    """course_id, k, cutoff, model, score."""
    return wide.unpivot(["course_id", "k", "cutoff"], list(models), "model", "score")
