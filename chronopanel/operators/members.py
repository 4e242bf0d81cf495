"""Members of the ensemble that need a fit or evidence from other courses, at every cutoff.

Each member sees the steps before its cutoff alone. A member that can't say anything at a cutoff has no row there, and the
ensemble leaves it out.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators import features as X
from chronopanel.operators import models as L
from chronopanel.operators.panel import FORMATS, before
from chronopanel.sources.tables import cut, drop_cut

#: Features that don't depend on the size of a course, and those that only its own exams give.
GENERIC = (
    "freq_all last1 freq_last3 ewma_short ewma_long linear_decay since_last never_seen streak_present streak_absent mean_gap gap_cv due_z hazard"
    " markov_next trend cooc_lift_last unit_ewma bayes_mean bayes_width hist_log base_rate"
).split()
COURSE_ONLY = (
    "count_log soft_ewma soft_mean sem_ewma sem_neighbors marks_share marks_share_recent high_mark_rate numerical_share derivation_share theory_share"
    " type_entropy hours_share marks_weight_share breadth exact_repeat_rate para_repeat_rate map_conf parse_conf marks_known optional_rate sem_density centrality"
).split()
#: Half lives of the recurrence variants, of formats, and strengths of priors.
HALF_LIVES = (None, 6.0, 3.0, 1.5)
FORMAT_HALF_LIFE, RATE_STRENGTH = 2.0, 2.0
REPOSITORY_PRECISION, COURSE_PRECISION = 5.0, 2.0
#: Courses invented to train the general model on, and the parts into which real courses are divided: a course is scored by
#: a model that saw the other parts alone.
INVENTED, PARTS = 120, 5
#: Formats that a syllabus tag speaks for.
TAGGED = ("numerical", "derivation", "theory", "definition", "diagram", "objective")


def posteriors(cells: DataFrame, units: DataFrame) -> DataFrame:
    """fit_recurrence() of every half life (variants inf, 6, 3, 1.5) and without units (flat), at every cutoff from 1."""
    flat = F.struct(F.lit("flat").alias("variant"), F.lit(None).cast("long").alias("unit"), "h_0", "n_0")
    every = [F.struct(F.lit(L.half_life_name(v)).alias("variant"), F.col("unit").cast("long").alias("unit"), f"h_{i}", f"n_{i}") for i, v in enumerate(HALF_LIVES)]
    sums = [c for i, v in enumerate(HALF_LIVES) for c in (L.weighted_sum("y", v).alias(f"h_{i}"), L.weighted_sum(None, v).alias(f"n_{i}"))]
    counts = cells.join(units, ["course_id", "k"]).select("course_id", "k", F.col("t").alias("cutoff"), "unit", *sums).where("cutoff > 0")
    one = "struct<variant: string, unit: bigint, h: double, n: double>"
    return L.fit_recurrence(counts.select("course_id", "k", "cutoff", F.inline(F.array(*[c.cast(one) for c in (*every, flat)]))))


def with_posterior(features: DataFrame, post: DataFrame) -> DataFrame:
    """features with bayes_mean and bayes_width of the undiscounted posterior, and its variance_ratio."""
    p = post.where("variant = 'inf'").select("course_id", "k", "cutoff", F.col("mean").alias("bayes_mean"), (F.col("high") - F.col("low")).alias("bayes_width"), "variance_ratio")
    return features.drop("bayes_mean", "bayes_width").join(p, ["course_id", "k", "cutoff"])


def recurrence_scores(post: DataFrame) -> DataFrame:
    """course_id, k, cutoff, model (bayes_inf, bayes_6, ...), score: the posterior mean; of equal ones the less certain first."""
    return post.where("variant <> 'flat'").select("course_id", "k", "cutoff", F.concat(F.lit("bayes_"), F.regexp_replace("variant", r"\.", "")).alias("model"), (F.col("mean") + 1e-6 * F.col("high")).alias("score"))


def _log_score(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.when(y > 0, F.ln(q)).otherwise(F.ln(1 - q))


def temporal_scores(features: DataFrame, post: DataFrame, cells: DataFrame) -> DataFrame:
    """course_id, k, cutoff, score, log_bayes_factor: the hazard of an item's gap times the root of its rate over the
    course's, or the plain recurrence mean: whichever gave the earlier exams of the course the higher chance."""
    simple = post.where("variant = 'flat'").select("course_id", "k", "cutoff", F.col("mean").alias("simple"))
    truth = cells.select("course_id", "k", F.col("t").alias("cutoff"), "y")
    x = features.select("course_id", "k", "cutoff", "hazard", "n", "steps", "base_rate", "ewma_short").join(simple, ["course_id", "k", "cutoff"]).join(truth, ["course_id", "k", "cutoff"], "left")
    p0 = F.col("base_rate") + 1e-9
    rate = (F.col("n") + RATE_STRENGTH * p0) / (F.col("steps") + RATE_STRENGTH)
    x = x.withColumn("timed", F.least(F.greatest(F.col("hazard") * F.sqrt(rate / p0), F.lit(1e-4)), F.lit(1 - 1e-4)))
    per = x.groupBy("course_id", "cutoff").agg(F.sum(_log_score(F.col("timed"), F.col("y")) - _log_score(F.col("simple"), F.col("y"))).alias("gain"))
    w = W.partitionBy("course_id").orderBy("cutoff").rowsBetween(W.unboundedPreceding, -1)
    past = per.select("course_id", "cutoff", F.coalesce(F.sum("gain").over(w), F.lit(0.0)).alias("log_bayes_factor"))
    chosen = F.when(F.col("log_bayes_factor") > 0, F.col("timed")).otherwise(F.col("simple"))
    return x.join(past, ["course_id", "cutoff"]).select("course_id", "k", "cutoff", (chosen + 1e-4 * F.col("ewma_short")).alias("score"), "log_bayes_factor")


def syllabus_share(statics: DataFrame) -> DataFrame:
    """course_id, k, share, source: an item's weight by the syllabus: teaching hours, else marks, else breadth, else alike."""
    w = W.partitionBy("course_id")
    hours, marks = F.max("hours_share").over(w) > 0, F.max("marks_weight_share").over(w) > 0
    varied = F.max("breadth").over(w) > F.min("breadth").over(w)
    share = F.when(hours, F.col("hours_share")).when(marks, F.col("marks_weight_share")).when(varied, F.col("breadth") + 0.5).otherwise(1.0)
    source = F.when(hours, "hours").when(marks, "marks").when(varied, "breadth").otherwise("uniform")
    return statics.select("course_id", "k", share.alias("share"), source.alias("source"))


def coverage_scores(cells: DataFrame, units: DataFrame, statics: DataFrame) -> DataFrame:
    """course_id, k, cutoff, score: how often a unit is examined, times the root of the item's weight within it. A course of
    a single unit and without weights has none."""
    per = cells.select("course_id", "k", "t", "y").join(units, ["course_id", "k"]).groupBy("course_id", F.col("unit").alias("k"), "t").agg(F.max("y").alias("y"))
    alone = per.select("course_id", "k", F.lit(None).cast("long").alias("unit")).distinct()
    rate = L.fit_recurrence(L.weighted_counts(per, alone), ()).select("course_id", F.col("k").alias("unit"), "cutoff", "mean")
    s = syllabus_share(statics).join(units, ["course_id", "k"])
    w = W.partitionBy("course_id", "unit")
    s = s.withColumn("within", F.col("share") / F.greatest(F.avg("share").over(w), F.lit(1e-12)))
    n = units.groupBy("course_id").agg(F.count_distinct("unit").alias("n_units"))
    s = s.join(n, "course_id").where("n_units > 1 or source <> 'uniform'")
    return s.join(rate, ["course_id", "unit"]).select("course_id", "k", "cutoff", (F.col("mean") * F.sqrt(F.greatest("within", F.lit(1e-6)))).alias("score"))


def format_prior(item_kinds: DataFrame) -> DataFrame:
    """course_id, k and 1 or 0 a format that the tags of an item's node or of nodes below speak for. item_kinds: course_id,
    k, kind."""
    return item_kinds.where(F.col("kind").isin(*TAGGED)).groupBy("course_id", "k").agg(*[F.max((F.col("kind") == f).cast("int")).alias(f"tag_{f}") for f in FORMATS])


def format_mixes(cells: DataFrame, formats: DataFrame) -> DataFrame:
    """course_id, k, cutoff, seen, formats_seen and, for each format, g_ and t_: the course's mix of formats before the cutoff
    and the item's, drawn to it by two questions; later exams weigh more."""
    x = cells.select("course_id", "k", "t").join(formats, ["course_id", "k", "t"], "left").na.fill(0, list(FORMATS))
    weight = F.pow(F.lit(2.0), F.col("t") / F.lit(FORMAT_HALF_LIFE))
    scale = F.pow(F.lit(2.0), -(F.col("t") - 1) / F.lit(FORMAT_HALF_LIFE))
    mine = x.select("course_id", "k", F.col("t").alias("cutoff"), *[(F.coalesce(F.sum(F.col(f) * weight).over(before()), F.lit(0.0)) * scale).alias(f"i_{f}") for f in FORMATS], F.coalesce(F.sum(sum(F.col(f) for f in FORMATS)).over(before()), F.lit(0)).alias("seen"))
    c = W.partitionBy("course_id", "cutoff")
    ever = x.groupBy("course_id", "t").agg(*[F.sum(f).alias(f) for f in FORMATS])
    wc = W.partitionBy("course_id").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    ever = ever.select("course_id", F.col("t").alias("cutoff"), sum((F.coalesce(F.sum(f).over(wc), F.lit(0)) > 0).cast("int") for f in FORMATS).alias("formats_seen"))
    total = sum(F.sum(f"i_{f}").over(c) for f in FORMATS) + 0.5 * len(FORMATS)
    mine = mine.select("*", *[((F.sum(f"i_{f}").over(c) + 0.5) / total).alias(f"g_{f}") for f in FORMATS])
    own = sum(F.col(f"i_{f}") for f in FORMATS) + 2
    mine = mine.select("course_id", "k", "cutoff", "seen", *[f"g_{f}" for f in FORMATS], *[((F.col(f"i_{f}") + 2 * F.col(f"g_{f}")) / own).alias(f"t_{f}") for f in FORMATS])
    return mine.join(ever, ["course_id", "cutoff"]).where("cutoff > 0")


def question_type_scores(mixes: DataFrame, prior: DataFrame) -> DataFrame:
    """course_id, k, cutoff, score: how an item's usual formats, drawn to its syllabus tags where it has little history, fit
    the course's recent mix. Courses of one format without tags that differ have none."""
    x = mixes.join(prior, ["course_id", "k"], "left")
    tags = sum(F.coalesce(f"tag_{f}", F.lit(0)) for f in FORMATS)
    weight = F.when(tags > 0, 1 / (1 + F.col("seen"))).otherwise(0.0)
    score = sum(((1 - weight) * F.col(f"t_{f}") + weight * F.coalesce(f"tag_{f}", F.lit(0)) / F.greatest(tags, F.lit(1))) * F.col(f"g_{f}") for f in FORMATS)
    c = W.partitionBy("course_id", "cutoff")
    differ = functools.reduce(Column.__or__, [F.max(F.coalesce(f"tag_{f}", F.lit(0))).over(c) > F.min(F.coalesce(f"tag_{f}", F.lit(0))).over(c) for f in FORMATS])
    return x.select("course_id", "k", "cutoff", score.alias("score"), ((F.col("formats_seen") >= 2) | differ).alias("_ok")).where("_ok").drop("_ok")


def generic_features(cells: DataFrame, units: DataFrame, post: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """course_id, k, cutoff and the GENERIC features at cutoffs from 1 on; made as in all_features()."""
    on = ["course_id", "k", "cutoff"]
    history, timing, pairs = [cut(x) for x in (X.history_features(cells).where("cutoff > 0"), X.timing_features(cells), X.cooccurrence_feature(cells))]
    if made is not None:
        made += [history, timing, pairs]
    x = history.join(timing, on).join(pairs, on)
    x = x.join(units, ["course_id", "k"]).join(X.unit_recency(cells, units), ["course_id", "unit", "cutoff"], "left")
    return with_posterior(x, post).select(*on, *GENERIC)


@functools.cache
def general_prior(spark: SparkSession, n: int = INVENTED) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, deviations, weights and intercept of a logistic model on the GENERIC features of n invented courses; their rows
    (about 300 a course) are brought to the driver once a session."""
    from chronopanel.operators.panel import CELL_SUMS

    made = cut(L.simulate_courses(spark, n))
    zeros = [F.lit(0.0).alias(c) for c in CELL_SUMS if c not in ("y", "n_questions")]
    cells = made.select("course_id", "t", "k", "y", F.col("y").alias("n_questions"), *zeros)
    units = made.select("course_id", "k", "unit").distinct()
    post = cut(L.fit_recurrence(L.weighted_counts(cells, units)))
    parts: list[DataFrame] = []
    rows = generic_features(cells, units, post, parts).join(cells.select("course_id", "k", F.col("t").alias("cutoff"), "y"), ["course_id", "k", "cutoff"]).orderBy("course_id", "cutoff", "k").toPandas()
    for df in (made, post, *parts):
        drop_cut(df)
    x, y = rows[GENERIC].fillna(0.0).to_numpy(float), rows["y"].to_numpy(float)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-9, 1.0, sd)
    w, b = L.map_logistic((x - mean) / sd, y, np.zeros(x.shape[1]), 0.0, 1.0)
    return mean, sd, w, b


def repository_models(rows: DataFrame, prior: tuple, parts: int = PARTS, rounds: int = 8) -> list[tuple[np.ndarray, float]]:
    """Weights and intercept of a model for each part of the courses, fitted on the rows of all other parts about the prior.

    rows: course_id, GENERIC features, y. Newton steps on sums over all rows: a round is one pass, and what comes to the
    driver is a matrix a part, whatever the number of rows.
    """
    mean, sd, w0, b0 = prior
    center = np.append(w0, b0)
    ridge = np.append(np.full(len(w0), REPOSITORY_PRECISION), 0.01)
    now = np.tile(center, (parts, 1))
    size = len(center)

    def sums(batches):
        total = np.zeros((parts, size * size + size))
        for b in batches:
            x = np.column_stack([np.nan_to_num((b[GENERIC].to_numpy(float) - mean) / sd), np.ones(len(b))])
            y, part = b["y"].to_numpy(float), b["part"].to_numpy()
            for m in range(parts):
                on = part != m
                a = x[on]
                p = 1 / (1 + np.exp(-np.clip(a @ now[m], -35, 35)))
                total[m] += np.concatenate([((a * (p * (1 - p))[:, None]).T @ a).ravel(), a.T @ (p - y[on])])
        yield pd.DataFrame({"m": np.repeat(np.arange(parts), total.shape[1]), "i": np.tile(np.arange(total.shape[1]), parts), "v": total.ravel()})

    parted = rows.select(*GENERIC, "y", F.pmod(F.xxhash64("course_id"), F.lit(parts)).cast("int").alias("part"))
    for _ in range(rounds):
        got = np.zeros((parts, size * size + size))
        for r in parted.mapInPandas(sums, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():  # parts x 552 numbers
            got[r["m"], r["i"]] = r["v"]
        steps = [np.linalg.solve(g[: size * size].reshape(size, size) + np.diag(ridge), g[size * size :] + ridge * (now[m] - center)) for m, g in enumerate(got)]
        now = now - np.clip(np.array(steps), -3, 3)
        if max(np.abs(s).max() for s in steps) < 1e-6:
            break
    return [(v[:-1], float(v[-1])) for v in now]


def general_scores(features: DataFrame, prior: tuple, models: list[tuple[np.ndarray, float]]) -> DataFrame:
    """course_id, k, cutoff, score: chance by the general model of the course's part, which never saw the course."""
    mean, sd, *_ = prior
    part = F.pmod(F.xxhash64("course_id"), F.lit(len(models)))
    z = lambda w, b: sum((float(c / s) * (F.coalesce(f, F.lit(0.0)) - float(m)) for f, c, m, s in zip(GENERIC, w, mean, sd, strict=True)), F.lit(float(b)))
    score = F.coalesce(*[F.when(part == i, 1 / (1 + F.exp(-F.least(F.greatest(z(w, b), F.lit(-30.0)), F.lit(30.0))))) for i, (w, b) in enumerate(models)])
    return features.select("course_id", "k", "cutoff", score.alias("score"))


def course_logistic(features: DataFrame, cells: DataFrame, prior: tuple, models: list[tuple[np.ndarray, float]], precision: float = COURSE_PRECISION) -> DataFrame:
    """course_id, k, cutoff, score: at each cutoff a logistic model on the course's rows of earlier cutoffs. The weights of
    GENERIC features are drawn to the general model's, those of COURSE_ONLY ones to zero; without rows it is the general one."""
    mean_g, sd_g, *_ = prior
    names, ng, parts = GENERIC + COURSE_ONLY, len(GENERIC), len(models)
    truth = cells.select("course_id", "k", F.col("t").alias("cutoff"), "y")
    rows = features.select("course_id", "k", "cutoff", *names).join(truth, ["course_id", "k", "cutoff"], "left").withColumn("part", F.pmod(F.xxhash64("course_id"), F.lit(parts)).cast("int"))

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out, x, c = [], g[names].fillna(0.0).to_numpy(float), g["cutoff"].to_numpy()
        w_g, b_g = models[int(g["part"].iloc[0])]
        w0, labels = np.append(w_g, np.zeros(len(COURSE_ONLY))), g["y"].to_numpy(float)
        for cut in np.unique(c):
            now, past = c == cut, (c < cut) & ~np.isnan(labels)
            mean, sd = (x[past, ng:].mean(0), x[past, ng:].std(0)) if past.any() else (np.zeros(len(COURSE_ONLY)), np.ones(len(COURSE_ONLY)))
            mean, sd = np.append(mean_g, mean), np.append(sd_g, np.where(sd < 1e-9, 1.0, sd))
            w, b = L.map_logistic((x[past] - mean) / sd, labels[past], w0, b_g, precision)
            z = (x[now] - mean) / sd @ w + b
            out.append(pd.DataFrame({"course_id": g["course_id"][now], "k": g["k"][now], "cutoff": cut, "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}))
        return pd.concat(out)

    return rows.groupBy("course_id").applyInPandas(fit, "course_id long, k long, cutoff int, score double")


def input_quality(cells: DataFrame, formats: DataFrame, exams: DataFrame, statics: DataFrame, pretrained: bool = False) -> DataFrame:
    """course_id, cutoff, member, quality: how good the inputs of a member are, by the exams before the cutoff: confidence of
    mappings and parsing, known marks, formats seen, weights in the syllabus, missing years."""
    wc = W.partitionBy("course_id").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    per = cells.groupBy("course_id", "t").agg(*[F.sum(c).alias(c) for c in ("n_questions", "map_conf_sum", "parse_conf_sum", "marks_known_sum")])
    kinds = formats.groupBy("course_id", "t").agg(*[F.sum(f).alias(f) for f in FORMATS])
    years = exams.where("year is not null").groupBy("course_id", "t").agg(F.min("year").alias("year"))
    x = per.join(kinds, ["course_id", "t"], "left").join(years, ["course_id", "t"], "left")
    q = F.sum("n_questions").over(wc)
    rate = lambda c: F.when(q > 0, F.sum(c).over(wc) / q).otherwise(1.0)
    seen = sum((F.coalesce(F.sum(f).over(wc), F.lit(0)) > 0).cast("int") for f in FORMATS)
    ys = F.collect_set("year").over(wc)
    span = F.array_max(ys) - F.array_min(ys) + 1
    temporal = F.when(F.size(ys) >= 2, 1 - 0.5 * (span - F.size(ys)) / span).otherwise(1.0)
    x = x.select("course_id", F.col("t").alias("cutoff"), rate("map_conf_sum").alias("mc"), rate("parse_conf_sum").alias("pc"), rate("marks_known_sum").alias("mk"), seen.alias("formats"), temporal.alias("temporal"))
    source = syllabus_share(statics).groupBy("course_id").agg(F.first("source").alias("source"))
    x = x.join(source, "course_id", "left").where("cutoff > 0")
    learned = 0.5 + 0.25 * F.col("mk") + 0.25 * F.col("pc")
    by = {
        "semantic": (0.5 + 0.5 * F.col("mc")) * (1.0 if pretrained else 0.8), "question_type": F.least(F.lit(1.0), F.greatest("formats", F.lit(1)) / 3.0),
        "coverage": F.when(F.col("source").isin("hours", "marks"), 1.0).when(F.col("source") == "breadth", 0.85).otherwise(0.7), "general": F.lit(1.0),
        **{m: F.col("temporal") for m in ("recency", "beta_binomial", "hazard", "markov", "hmm", "cooccurrence")}, **{m: learned for m in ("logistic",)},
    }
    return x.select("course_id", "cutoff", F.explode(F.create_map(*[v for m, c in by.items() for v in (F.lit(m), c.cast("double"))])).alias("member", "quality"))


#: Parameters that a member estimates from the course, and members that bring knowledge from outside it.
DEGREES = {
    "recency": 1.0, "beta_binomial": 1.0, "semantic": 0.5, "coverage": 0.5, "question_type": 1.0, "cooccurrence": 3.0, "hazard": 3.0, "markov": 2.0, "hmm": 5.0,
    "general": 0.0, "logistic": 0.5 * (len(GENERIC) + len(COURSE_ONLY)),
}
OUTSIDE = ("semantic", "coverage", "general")


def evidence_weights(folds: DataFrame, scored: DataFrame, exams: DataFrame, quality: DataFrame, metric: str = "ndcg", tau: float = 2.0, shrink: float = 3.0, least: float = 0.05, pretrained: bool = False) -> DataFrame:
    """course_id, cutoff, member, reliability, skill, folds, weight (they sum to 1 at a cutoff).

    reliability: quality times exams / (exams + parameters), a pseudo exam more for outside knowledge, half an exam less for
    each without a year. skill: mean gain over the average member on earlier folds, by the spread of members within folds,
    drawn to 0 by the number of folds. weight: reliability times exp(tau x skill). scored: course_id, cutoff, model of the
    members that have scores there.
    """
    members = list(DEGREES)
    there = scored.where(F.col("model").isin(*members)).select("course_id", "cutoff", F.col("model").alias("member")).distinct()
    f = folds.where(F.col("model").isin(*members)).select("course_id", F.col("cutoff").alias("s"), F.col("model").alias("member"), F.col(metric).alias("v"))
    w = W.partitionBy("course_id", "s")
    f = f.withColumn("m", F.count("*").over(w)).withColumn("d", F.col("v") - F.avg("v").over(w)).where("m >= 2")
    # Running sums over the folds before each cutoff.
    before_ = lambda *keys: W.partitionBy(*keys).orderBy("s").rangeBetween(W.unboundedPreceding, -1)
    spread = f.groupBy("course_id", "s").agg(F.sum("d").alias("a"), F.sum(F.col("d") * F.col("d")).alias("b"), F.count("*").alias("c"))
    grid = there.select("course_id", F.col("cutoff").alias("s")).distinct()
    spread = grid.join(spread, ["course_id", "s"], "full_outer")
    n = F.sum("c").over(before_("course_id"))
    sd = F.sqrt(F.greatest(F.sum("b").over(before_("course_id")) / n - F.pow(F.sum("a").over(before_("course_id")) / n, F.lit(2)), F.lit(0.0)))
    spread = spread.select("course_id", F.col("s").alias("cutoff"), F.greatest(F.when(n > 1, sd).otherwise(0.0), F.lit(least)).alias("sd"))
    mine = there.select("course_id", F.col("cutoff").alias("s"), "member").join(f.select("course_id", "s", "member", "d"), ["course_id", "s", "member"], "full_outer")
    mine = mine.select("course_id", F.col("s").alias("cutoff"), "member", F.avg("d").over(before_("course_id", "member")).alias("raw"), F.count("d").over(before_("course_id", "member")).alias("folds"))
    wc = W.partitionBy("course_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    e = exams.groupBy("course_id", "t").agg(F.max(F.col("year").isNull().cast("int")).alias("u")).select("course_id", (F.col("t") + 1).alias("cutoff"), (F.count("*").over(wc) - 0.5 * F.sum("u").over(wc)).alias("exams"))
    x = there.join(mine, ["course_id", "cutoff", "member"]).join(spread, ["course_id", "cutoff"]).join(e, ["course_id", "cutoff"], "left").join(quality, ["course_id", "cutoff", "member"], "left")
    df = F.create_map(*[v for m, d in DEGREES.items() for v in (F.lit(m), F.lit(float(d)))])[F.col("member")]
    more = F.col("member").isin(*[m for m in OUTSIDE if m != "semantic" or pretrained]).cast("double")
    n_exams = F.coalesce("exams", F.lit(0.0))
    rho = F.coalesce("quality", F.lit(1.0)) * F.when(df <= 0, 1.0).otherwise((n_exams + more) / (n_exams + more + df))
    skill = F.coalesce(F.col("raw") / F.col("sd") * (F.col("folds") / (F.col("folds") + shrink)), F.lit(0.0))
    x = x.select("course_id", "cutoff", "member", rho.alias("reliability"), skill.alias("skill"), "folds", (rho * F.exp(tau * skill)).alias("base"))
    return x.withColumn("weight", F.col("base") / F.sum("base").over(W.partitionBy("course_id", "cutoff"))).drop("base")


def gated_ensemble(ranks: DataFrame, weights: DataFrame, doubt: DataFrame, strength: float = 1.0) -> DataFrame:
    """course_id, k, cutoff, member, weight, rank, share: what each member adds to an item's score, the sum of the shares.

    ranks: course_id, k, cutoff, member, rank (percentile). doubt: course_id, k, cutoff, variance_ratio; items whose history
    says little lean more on outside knowledge."""
    x = ranks.join(weights.select("course_id", "cutoff", "member", "weight"), ["course_id", "cutoff", "member"]).join(doubt, ["course_id", "k", "cutoff"], "left")
    gate = F.when(F.col("member").isin(*OUTSIDE), 1 + strength * F.coalesce("variance_ratio", F.lit(1.0))).otherwise(1.0)
    x = x.withColumn("g", F.col("weight") * gate)
    x = x.withColumn("weight", F.col("g") / F.sum("g").over(W.partitionBy("course_id", "k", "cutoff")))
    return x.select("course_id", "k", "cutoff", "member", "weight", "rank", (F.col("weight") * F.col("rank")).alias("share"))


def evidence_label(ratio: Column) -> Column:
    """How much an item's own history has narrowed its estimate, by the ratio of posterior to prior variance."""
    return F.when(ratio < 0.3, "Strong").when(ratio < 0.5, "Moderate").when(ratio < 0.75, "Limited").otherwise("Minimal")


def member_status(weights: DataFrame, members: tuple[str, ...] = tuple(DEGREES)) -> DataFrame:
    """course_id, cutoff, member, status, weight: unavailable, downweighted (clearly worse than the average member and of
    little weight), limited (reliability below a half) or active."""
    every = weights.select("course_id", "cutoff").distinct().withColumn("member", F.explode(F.array(*[F.lit(m) for m in members])))
    n = F.count("weight").over(W.partitionBy("course_id", "cutoff"))
    x = every.join(weights, ["course_id", "cutoff", "member"], "left").withColumn("n", n)
    status = F.when(F.col("weight").isNull(), "unavailable").when((F.col("skill") < -0.25) & (F.col("weight") < 0.5 / F.col("n")), "downweighted").when(F.col("reliability") < 0.5, "limited").otherwise("active")
    return x.select("course_id", "cutoff", "member", status.alias("status"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
