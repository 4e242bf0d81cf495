"""Gap, hazard, transition and trend statistics of items at every cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators.panel import before

MAX_GAP = 6


def ewma(value: str, half_life: float) -> Column:
    """Mean of the earlier steps, each weighted by half for half_life steps of age; null before any. Weights are powers of
    two of the step itself, which cancel out."""
    w = F.pow(F.lit(2.0), F.col("t") / F.lit(half_life))
    return F.sum(F.col(value) * w).over(before()) / F.sum(w).over(before())


def linear_decay(value: str = "y") -> Column:
    """Mean of the earlier steps weighted 1 to T; needs with_position()."""
    return F.sum(F.col(value) * F.col("_n")).over(before()) / F.sum("_n").over(before())


def with_position(cells: DataFrame) -> DataFrame:
    """Adds _n, the position of a step in the course from 1."""
    return cells.withColumn("_n", F.row_number().over(W.partitionBy("course_id", "k").orderBy("t")))


def since_last() -> Column:
    """Steps since the last appearance; one more than there are steps if there was none."""
    seen = F.max(F.when(F.col("y") > 0, F.col("t"))).over(before())
    return F.coalesce(F.col("t") - seen, F.col("t") + 1).cast("long")


def streaks(cells: DataFrame) -> DataFrame:
    """course_id, k, cutoff, present, absent: the run of equal steps that ends just before the cutoff."""
    w = before()
    x = cells.select("*", F.max(F.when(F.col("y") > 0, F.col("t"))).over(w).alias("one"), F.max(F.when(F.col("y") == 0, F.col("t"))).over(w).alias("nil"))
    one, nil = F.coalesce("one", F.lit(-1)), F.coalesce("nil", F.lit(-1))
    return x.select(
        "course_id", "k", F.col("t").alias("cutoff"), F.when(one > nil, F.col("t") - 1 - nil).otherwise(0).cast("long").alias("present"),
        F.when(nil > one, F.col("t") - 1 - one).otherwise(0).cast("long").alias("absent"),
    )


def gaps(cells: DataFrame) -> DataFrame:
    """course_id, k, t, gap: steps between consecutive appearances, at the later one."""
    seen = cells.where("y > 0").withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy("course_id", "k").orderBy("t")))
    return seen.where("gap is not null").select("course_id", "k", "t", F.col("gap").cast("long").alias("gap"))


def gap_stats(cells: DataFrame) -> DataFrame:
    """course_id, k, mean_gap, sd_gap (of a sample; null below two), n_gaps; only items that appeared twice."""
    return gaps(cells).groupBy("course_id", "k").agg(F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd_gap"), F.count("*").alias("n_gaps"))


def gap_at(cells: DataFrame) -> DataFrame:
    """Adds gap: bucketed steps since the last appearance (null if none yet); the first exam has no gap."""
    return cells.withColumn("gap", F.least(F.col("t") - F.max(F.when(F.col("y") > 0, F.col("t"))).over(before()), F.lit(MAX_GAP)).cast("long"))


def pooled_hazard(cells: DataFrame, strength: float = 3.0) -> DataFrame:
    """course_id, gap (0: never seen), hits, opportunities, rate: how often items come back after a gap, drawn to the
    course's base rate by strength. The first exam offers no gap and doesn't count."""
    base = cells.groupBy("course_id").agg(F.avg("y").alias("base"))
    per = gap_at(cells).where("t > 0").groupBy("course_id", F.coalesce("gap", F.lit(0)).cast("long").alias("gap")).agg(F.sum("y").alias("hits"), F.count("*").alias("opportunities"))
    return per.join(base, "course_id").select("course_id", "gap", "hits", "opportunities", ((F.col("hits") + strength * F.col("base")) / (F.col("opportunities") + strength)).alias("rate"))


def hazard_at(cells: DataFrame, strength: float = 3.0) -> DataFrame:
    """course_id, k, hazard of the next exam: the rate of the item's gap, the base rate where the gap was never met."""
    last_seen = cells.groupBy("course_id", "k").agg(F.max(F.when(F.col("y") > 0, F.col("t"))).alias("seen"), (F.max("t") + 1).alias("c"))
    gap = last_seen.select("course_id", "k", F.coalesce(F.least(F.col("c") - F.col("seen"), F.lit(MAX_GAP)), F.lit(0)).cast("long").alias("gap"))
    base = cells.groupBy("course_id").agg(F.avg("y").alias("base"))
    rates = pooled_hazard(cells, strength).select("course_id", "gap", "rate")
    return gap.join(base, "course_id").join(rates, ["course_id", "gap"], "left").select("course_id", "k", F.coalesce("rate", "base").alias("hazard"))


def transition_counts(cells: DataFrame) -> DataFrame:
    """course_id, k, n00, n01, n10, n11: what follows what from one exam to the next."""
    p = F.lag("y").over(W.partitionBy("course_id", "k").orderBy("t"))
    x = cells.withColumn("p", p).where("p is not null")
    count = lambda a, b: F.count(F.when((F.col("p") == a) & (F.col("y") == b), 1)).alias(f"n{a}{b}")
    return x.groupBy("course_id", "k").agg(count(0, 0), count(0, 1), count(1, 0), count(1, 1))


def trend_slope(cells: DataFrame, window: int = 6) -> DataFrame:
    """course_id, k, slope: least-squares slope over the last exams, 0 with fewer than three."""
    end = cells.withColumn("_m", F.max("t").over(W.partitionBy("course_id", "k")))
    part = end.where(F.col("t") > F.col("_m") - window)
    return part.groupBy("course_id", "k").agg(F.when(F.count("*") >= 3, F.regr_slope("y", F.col("t").cast("double"))).otherwise(0.0).alias("slope"))


def sequential_lift(cells: DataFrame, strength: float = 2.0) -> DataFrame:
    """course_id, j, k, together, lift: P(k next | j now) against P(k), smoothed; pairs that never follow are left out.

    Only present cells are joined, on course and step, so the work is that of the pairs that occur."""
    now = cells.where("y > 0").select("course_id", F.col("k").alias("j"), (F.col("t") + 1).alias("t"))
    nxt = cells.where("y > 0").select("course_id", "k", "t")
    last_step = cells.groupBy("course_id").agg(F.max("t").alias("end"))
    n = cells.where("y > 0").join(last_step, "course_id").where("t < end").groupBy("course_id", F.col("k").alias("j")).agg(F.count("*").alias("n_j"))
    base = cells.groupBy("course_id", "k").agg(F.avg("y").alias("base"))
    pairs = now.join(nxt, ["course_id", "t"]).groupBy("course_id", "j", "k").agg(F.count("*").alias("together"))
    x = pairs.join(n, ["course_id", "j"]).join(base, ["course_id", "k"])
    p = (F.col("together") + strength * F.col("base")) / (F.col("n_j") + strength)
    return x.select("course_id", "j", "k", "together", (p / (F.col("base") + 1e-6)).alias("lift"))


def same_exam_lift(cells: DataFrame, strength: float = 2.0) -> DataFrame:
    """course_id, j, k (j < k), together, lift: P(k | j in the same exam) against P(k), smoothed."""
    seen = cells.where("y > 0").select("course_id", "t", "k")
    n = seen.groupBy("course_id", F.col("k").alias("j")).agg(F.count("*").alias("n_j"))
    base = cells.groupBy("course_id", "k").agg(F.avg("y").alias("base"))
    pairs = seen.withColumnRenamed("k", "j").join(seen, ["course_id", "t"]).where("j < k").groupBy("course_id", "j", "k").agg(F.count("*").alias("together"))
    x = pairs.join(n, ["course_id", "j"]).join(base, ["course_id", "k"])
    p = (F.col("together") + strength * F.col("base")) / (F.col("n_j") + strength)
    return x.select("course_id", "j", "k", "together", (p / (F.col("base") + 1e-6)).alias("lift"))


def rotation_tests(cells: DataFrame, min_gaps: int = 3, draws: int = 500, seed: int = 7) -> DataFrame:
    """course_id, k, period, p_value: whether an item's gaps are more even than chance would make them.

    The coefficient of variation (population) of the gaps is compared with those of random placements of as many
    appearances; items with fewer than min_gaps + 1 appearances or a mean gap up to 1.05 aren't tested. Seeded a group.
    """
    import numpy as np
    import pandas as pd

    def test(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t, n_steps = np.sort(pdf["t"].to_numpy()), int(pdf["steps"].iloc[0])
        g = np.diff(t)
        if len(t) < min_gaps + 1 or g.mean() <= 1.05:
            return pd.DataFrame({"course_id": [], "k": [], "period": [], "p_value": []})
        rng = np.random.default_rng((seed, abs(int(key[0])), abs(int(key[1]))))
        cv = g.std() / g.mean()
        sets = np.sort(np.argsort(rng.random((draws, n_steps)), axis=1)[:, : len(t)], axis=1)
        other = np.diff(sets, axis=1)
        low = (other.std(1) / other.mean(1) <= cv + 1e-12).sum()
        return pd.DataFrame({"course_id": [key[0]], "k": [key[1]], "period": [float(g.mean())], "p_value": [float((low + 1) / (draws + 1))]})

    steps = cells.groupBy("course_id").agg((F.max("t") + 1).alias("steps"))
    return cells.where("y > 0").join(steps, "course_id").select("course_id", "k", "t", "steps").groupBy("course_id", "k").applyInPandas(test, "course_id long, k long, period double, p_value double")
