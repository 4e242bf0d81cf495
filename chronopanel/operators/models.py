"""Models that need iteration: recurrence by a hierarchical beta-binomial, hidden Markov, MAP logistic, trees, calibration.

The parallel axis is the course (and cutoff); a group is one course's items by its exams. Fits are numpy inside
applyInPandas; random draws are seeded by group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.functions.numerics import beta_quantiles, golden_section, golden_sections, log_gamma

CHANCE = 0.8
#: Share of items in a usual exam, strength of an item's prior before any data, spread of its logarithm.
PRIOR_RATE, PRIOR_KAPPA, KAPPA_SPREAD = 0.4, 2.0, 1.0


def _strength(h: np.ndarray, n: float, mu: np.ndarray) -> float:
    """The most likely strength of the prior mu under the beta-binomial counts and a log-normal hyperprior."""
    if n <= 0 or len(h) < 2:
        return PRIOR_KAPPA

    def cost(s: float) -> float:
        a, b = np.maximum(mu * math.exp(s), 1e-6), np.maximum((1 - mu) * math.exp(s), 1e-6)
        like = log_gamma(h + a) + log_gamma(n - h + b) - log_gamma(n + a + b) - log_gamma(a) - log_gamma(b) + log_gamma(a + b)
        return 0.5 * ((s - math.log(PRIOR_KAPPA)) / KAPPA_SPREAD) ** 2 - float(like.sum())

    return math.exp(golden_section(cost, math.log(0.05), math.log(500.0)))


def posterior(h: np.ndarray, n: float, unit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """a, b of every item's beta posterior, its prior mean and the strength. h: appearances, n: exams, both by recency."""
    k = max(len(h), 1)
    course = (h.sum() + 2 * PRIOR_RATE * k) / (n * k + 2 * k)
    mu = np.full(len(h), course)
    if unit is not None:
        _, of = np.unique(unit, return_inverse=True)
        hits, size, m = np.bincount(of, weights=h), np.bincount(of), 2 * PRIOR_KAPPA
        mu = ((hits + m * course) / (n * size + m))[of]
    mu = np.clip(mu, 1e-3, 1 - 1e-3)
    kappa = _strength(h, n, mu)
    return np.maximum(mu * kappa + h, 1e-6), np.maximum((1 - mu) * kappa + (n - h), 1e-6), mu, kappa


def in_groups(df: DataFrame, keys: tuple[str, ...], fit, schema: str) -> DataFrame:
    """fit() of many whole groups at once: its frame is sorted by the keys and its last argument numbers the groups from 0.
    A batch ends where a group ends, so that a call costs little a group and holds a batch and the longest group at most.
    A frame without rows isn't handed to Spark: an empty column of numbers can't become its strings."""

    def moved(x: pd.DataFrame) -> np.ndarray:
        out = np.zeros(max(len(x) - 1, 0), bool)
        for c in keys:
            v = x[c].to_numpy()
            out |= v[1:] != v[:-1]
        return out

    def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
        x = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        out = fit(x, np.append(0, np.cumsum(moved(x))))
        # Strings in pieces, as pandas joins them, can't be handed back to Spark.
        return out.astype({c: object for c, t in out.dtypes.items() if pd.api.types.is_string_dtype(t)})

    def run(batches):
        held: list[pd.DataFrame] = []
        for x in batches:
            if not len(x):
                continue
            if len(ends := np.flatnonzero(moved(x))):
                end = int(ends[-1]) + 1
                if len(out := done([*held, x.iloc[:end]])):
                    yield out
                held = [x.iloc[end:]]
            else:
                held.append(x)
        if held and len(out := done(held)):
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _runs(of: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by group and columns, the run of equal ones that each ordered row is in, and where runs start."""
    order = np.lexsort((*columns[::-1], of))
    new = np.ones(len(of), bool)
    new[1:] = False
    for v in (of, *columns):
        new[1:] |= v[order][1:] != v[order][:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _strengths(h: np.ndarray, n: np.ndarray, mu: np.ndarray, count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """_strength() of each group; rows are distinct in group, h and mu, and count says how often."""
    start = np.flatnonzero(np.diff(of, prepend=-1))
    size, rest = np.add.reduceat(count, start), n[of] - h

    def cost(s: np.ndarray) -> np.ndarray:
        e = np.exp(s)
        a, b = mu * e[of], (1 - mu) * e[of]
        like = np.add.reduceat(count * (log_gamma(h + a) + log_gamma(rest + b) - log_gamma(a) - log_gamma(b)), start)
        return 0.5 * ((s - math.log(PRIOR_KAPPA)) / KAPPA_SPREAD) ** 2 - like - size * (log_gamma(e) - log_gamma(n + e))

    best = np.exp(golden_sections(cost, math.log(0.05), math.log(500.0), len(start)))
    return np.where((n <= 0) | (size < 2), PRIOR_KAPPA, best)


def posteriors_of(h: np.ndarray, n: np.ndarray, unit: np.ndarray, alone: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """posterior() of many groups: a, b, mu of every row and the strength of every group. n: a number a group; alone: rows
    without a unit; of: rising group numbers from 0."""
    start = np.flatnonzero(np.diff(of, prepend=-1))
    k = np.diff(np.append(start, len(of)))
    course = (np.add.reduceat(h, start) + 2 * PRIOR_RATE * k) / (n * k + 2 * k)
    order, run, first = _runs(of, alone, unit)
    g, m = of[order][first], 2 * PRIOR_KAPPA
    drawn = (np.add.reduceat(h[order], first) + m * course[g]) / (n[g] * np.diff(np.append(first, len(of))) + m)
    mu = np.empty(len(h))
    mu[order] = np.where(np.logical_and.reduceat(alone, start)[g], course[g], drawn)[run]
    mu = np.clip(mu, 1e-3, 1 - 1e-3)
    order, _, first = _runs(of, mu, h)
    kappa = _strengths(h[order][first], n, mu[order][first], np.diff(np.append(first, len(of))).astype(float), of[order][first])
    return np.maximum(mu * kappa[of] + h, 1e-6), np.maximum((1 - mu) * kappa[of] + (n[of] - h), 1e-6), mu, kappa


def fit_recurrence(counts: DataFrame, quantiles: tuple[str, ...] = ("inf",)) -> DataFrame:
    """course_id, k, cutoff, variant, mean, low, high, kappa, variance_ratio.

    counts: course_id, k, cutoff, variant, unit (null: none), h (weighted appearances), n (weighted exams). The course's rate
    is drawn to PRIOR_RATE as by two exams, a unit's to the course's, an item's to its unit's by kappa, the most likely
    strength. low and high bound 80 % of the posterior, exactly for the variants of quantiles, else by its standard
    deviation; variance_ratio compares its variance with the prior's, at most 1.
    """

    def fit(x: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        h = x["h"].to_numpy(float)
        n = np.maximum.reduceat(x["n"].to_numpy(float), np.flatnonzero(np.diff(of, prepend=-1)))
        a, b, mu, kappa = posteriors_of(h, n, x["unit"].to_numpy(), x["alone"].to_numpy(), of)
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        reach = 1.2816 * np.sqrt(var)
        low, high = np.maximum(mean - reach, 0), np.minimum(mean + reach, 1)
        exact = np.flatnonzero(x["variant"].isin(quantiles))
        if len(exact):
            order, run, first = _runs(of[exact], a[exact], b[exact])
            one = exact[order][first]
            for v, p in ((low, (1 - CHANCE) / 2), (high, (1 + CHANCE) / 2)):
                v[exact[order]] = beta_quantiles(p, a[one], b[one])[run]
        ratio = np.clip(var / np.maximum(mu * (1 - mu) / (kappa[of] + 1), 1e-12), 0, 1)
        return pd.DataFrame({"course_id": x["course_id"], "k": x["k"], "cutoff": x["cutoff"], "variant": x["variant"], "mean": mean, "low": low, "high": high, "kappa": kappa[of], "variance_ratio": ratio})

    rows = counts.select("course_id", "k", "cutoff", "variant", "h", "n", F.coalesce("unit", F.lit(0)).alias("unit"), F.col("unit").isNull().alias("alone"))
    return in_groups(rows, ("course_id", "cutoff", "variant"), fit, "course_id long, k long, cutoff int, variant string, mean double, low double, high double, kappa double, variance_ratio double")


def half_life_name(half_life: float | None) -> str:
    return f"{half_life:g}" if half_life else "inf"


def weighted_sum(value: str | None, half_life: float | None) -> Column:
    """Sum of a column (of 1 for None) over the steps before each, halved every half_life steps of age."""
    w = W.partitionBy("course_id", "k").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    weight = F.pow(F.lit(2.0), F.col("t") / F.lit(half_life)) if half_life else F.lit(1.0)
    scale = F.pow(F.lit(2.0), -(F.col("t") - 1) / F.lit(half_life)) if half_life else F.lit(1.0)
    return F.sum(F.col(value) * weight if value else weight).over(w) * scale


def weighted_counts(cells: DataFrame, units: DataFrame, half_life: float | None = None) -> DataFrame:
    """Counts for fit_recurrence() at every cutoff from 1: appearances and exams, halved every half_life steps of age.
    units: course_id, k, unit. variant names the half life."""
    x = cells.join(units, ["course_id", "k"]).select("course_id", "k", F.col("t").alias("cutoff"), F.lit(half_life_name(half_life)).alias("variant"), F.col("unit").cast("long").alias("unit"), weighted_sum("y", half_life).alias("h"), weighted_sum(None, half_life).alias("n"))
    return x.where("cutoff > 0")


def _hidden_states(y: np.ndarray, count: np.ndarray, of: np.ndarray, rounds: int) -> np.ndarray:
    """Chance of the next appearance of each column of y (steps by items, 0 or 1) under a cold and a hot state shared by all
    items of a group; of: rising group numbers from 0, count: how many items are alike."""
    # Where the fit starts.
    groups, steps = int(of[-1]) + 1, len(y)
    start, trans, emit = np.tile([[0.6], [0.4]], groups), np.tile([[[0.8], [0.2]], [[0.3], [0.7]]], groups), np.tile([[0.15], [0.75]], groups)

    def forward(y, of, start, trans, emit):
        e, tr = emit[:, of], trans[:, :, of]
        like = np.where(y[None] > 0, e[:, None], 1 - e[:, None])
        f, scale = np.empty((2, *y.shape)), np.empty(y.shape)
        for t in range(steps):
            f[:, t] = (f[0, t - 1] * tr[0] + f[1, t - 1] * tr[1] if t else start[:, of]) * like[:, t]
            scale[t] = np.maximum(f[0, t] + f[1, t], 1e-12)
            f[:, t] /= scale[t]
        return f, scale, like, tr

    on, before = np.arange(groups), np.full(groups, -np.inf)
    y_on, count_on, of_on = y, count, of
    for _ in range(rounds):
        first = np.flatnonzero(np.diff(of_on, prepend=-1))
        total = lambda v: np.add.reduceat(v * count_on, first, axis=-1)  # noqa: B023, E731
        f, scale, like, tr = forward(y_on, of_on, start[:, on], trans[:, :, on], emit[:, on])
        b = np.ones(f.shape)
        moves = np.zeros((2, 2, y_on.shape[1]))
        for t in range(steps - 2, -1, -1):
            ahead = like[:, t + 1] * b[:, t + 1]
            b[:, t] = (tr[:, 0] * ahead[0] + tr[:, 1] * ahead[1]) / scale[t + 1]
            xi = f[:, None, t] * tr * ahead[None]
            moves += xi / np.maximum(xi.sum((0, 1)), 1e-12)
        post = f * b
        post /= np.maximum(post.sum(0), 1e-300)
        now, moves, items = total(np.log(scale).sum(0)), total(moves), np.add.reduceat(count_on, first)
        begin, step = (total(post[:, 0]) + 1) / (items + 2), (moves + 1) / (moves.sum(1, keepdims=True) + 2)
        shown = np.clip((total((post * y_on).sum(1)) + 0.5) / (total(post.sum(1)) + 1), 0.01, 0.99)
        turn = shown[0] > shown[1]
        start[:, on], trans[:, :, on], emit[:, on] = np.where(turn, begin[::-1], begin), np.where(turn, step[::-1, ::-1], step), np.where(turn, shown[::-1], shown)
        go = np.abs(now - before[on]) >= 1e-5
        before[on] = now
        if not go.any():
            break
        if not go.all():
            keep = go[of_on]
            on, y_on, count_on, of_on = on[go], y_on[:, keep], count_on[keep], (np.cumsum(go) - 1)[of_on[keep]]
    f, _, _, tr = forward(y, of, start, trans, emit)
    end = f[0, -1] * tr[0] + f[1, -1] * tr[1]
    return (end * emit[:, of]).sum(0)


def pooled_hmm(cells: DataFrame, rounds: int = 60) -> DataFrame:
    """course_id, k, cutoff, score: chance of appearing at the cutoff under a hidden cold and hot state shared by a course's
    items, fitted on the steps before it; every cutoff from 1 to the one after the last exam. cells hold that step, too."""

    def fit(g: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        out, length = np.empty(len(g)), g["past"].map(len).to_numpy()
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            y = np.stack(g["past"].to_numpy()[at]).astype(np.uint8)
            _, mine = np.unique(of[at], return_inverse=True)
            # Items of a group with one history are one column.
            rows = np.column_stack([mine.astype(">u4")[:, None].view(np.uint8), np.packbits(y, axis=1)])
            _, one, same, count = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
            out[at] = _hidden_states(y[one].T.astype(float), count.astype(float), mine[one], rounds)[same]
        return pd.DataFrame({"course_id": g["course_id"], "k": g["k"], "cutoff": g["cutoff"], "score": out})

    w = W.partitionBy("course_id", "k").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    past = cells.select("course_id", "k", F.col("t").alias("cutoff"), F.collect_list((F.col("y") > 0).cast("byte")).over(w).alias("past")).where("cutoff > 0")
    return in_groups(past, ("cutoff", "course_id"), fit, "course_id long, k long, cutoff int, score double")


def map_logistic(x: np.ndarray, y: np.ndarray, w0: np.ndarray, b0: float, precision: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of least logistic loss plus half the precision times their squared distance from w0 (0.01 for the
    bias), by damped Newton steps; the prior itself without rows."""
    if not len(x):
        return w0.copy(), b0
    a, w = np.column_stack([x, np.ones(len(x))]), np.append(w0, b0).astype(float)
    center, ridge = w.copy(), np.append(np.full(x.shape[1], precision), 0.01)
    loss = lambda v: np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ v)).sum() + 0.5 * (ridge * (v - center) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (p - y) + ridge * (w - center)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        new = loss(w)
        if now - new < 1e-9:
            break
        now = new
    return w[:-1], float(w[-1])


TREE_FEATURES = ["freq_all", "ewma_short", "ewma_long", "last1", "since_last", "never_seen", "gap_cv", "markov_next", "hazard", "bayes_mean", "marks_share", "sem_ewma"]


def tree_scores(features: DataFrame, cells: DataFrame, kind: str = "forest", seed: int = 11) -> DataFrame:
    """course_id, k, score of the next exam by MLlib trees trained on all courses' earlier rows."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    truth = cells.select("course_id", "k", F.col("t").alias("cutoff"), F.col("y").cast("double").alias("label"))
    x = VectorAssembler(inputCols=TREE_FEATURES, outputCol="features").transform(features.select("course_id", "k", "cutoff", *TREE_FEATURES))
    past = x.join(truth, ["course_id", "k", "cutoff"])
    end = cells.groupBy("course_id").agg((F.max("t") + 1).alias("cutoff"))
    now = x.join(end, ["course_id", "cutoff"])
    model = RandomForestClassifier(numTrees=20, maxDepth=5, minInstancesPerNode=5, seed=seed) if kind == "forest" else GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.1, seed=seed)
    return model.fit(past).transform(now).select("course_id", "k", vector_to_array("probability")[1].alias("score"))


def fit_platt(s: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset of a logistic curve, the slope alone drawn to 0."""
    w, b = map_logistic(s[:, None], y, np.zeros(1), 0.0, ridge)
    return float(w[0]), b


def fit_isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: places and values of the rising step curve, values between 0.01 and 0.99."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []
    for x, v in zip(s[order], y[order], strict=True):
        blocks.append([float(x), float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            x2, v2, n2 = blocks.pop()
            x1, v1, n1 = blocks.pop()
            blocks.append([x1, (v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.array([b[0] for b in blocks]), np.clip(np.array([b[1] for b in blocks]), 0.01, 0.99)


def calibrate(scored: DataFrame, method: str = "platt") -> DataFrame:
    """course_id, k, cutoff, p, y: percentile scores turned to probabilities by a curve fitted on the course's earlier
    folds; the base rate of those before there are two classes. scored: course_id, k, cutoff, score, y."""

    def fit(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["cutoff", "k"])
        s = g.groupby("cutoff")["score"].rank(pct=True).to_numpy(float)
        y, c = g["y"].to_numpy(float), g["cutoff"].to_numpy()
        p = np.empty(len(g))
        for t in np.unique(c):
            past, now = c < t, c == t
            if past.any() and len(set(y[past].tolist())) > 1:
                if method == "platt":
                    a, b = fit_platt(s[past], y[past])
                    p[now] = 1 / (1 + np.exp(-(a * s[now] + b)))
                else:
                    at, v = fit_isotonic(s[past], y[past])
                    p[now] = v[np.clip(np.searchsorted(at, s[now], "right") - 1, 0, len(v) - 1)]
            else:
                p[now] = np.clip(y[past].mean() if past.any() else 0.3, 0.01, 0.99)
        return pd.DataFrame({"course_id": g["course_id"], "k": g["k"], "cutoff": c, "p": p, "y": y})

    return scored.select("course_id", "k", "cutoff", "score", "y").groupBy("course_id").applyInPandas(fit, "course_id long, k long, cutoff int, p double, y double")


def rank_intervals(shares: DataFrame, post: DataFrame, cells: DataFrame, draws: int = 200, seed: int = 13) -> DataFrame:
    """course_id, k, rank, rank_low, rank_high, level of a forecast.

    shares: course_id, k, member, weight, rank of the ensemble; post: course_id, k, mean, kappa, variance_ratio of the
    recurrence posterior; cells: the past. Ranks are drawn with the member beta_binomial from its posterior and weights from
    a Dirichlet distribution about the fitted ones, surer the more exams there are; the range of ranks when each past exam
    is left out in turn (recurrence alone is fitted anew) is added. Low below a fifth of the items, Medium below two fifths;
    an item whose variance is still three quarters (half) of the prior's is High (at least Medium).
    """

    def places(s: np.ndarray) -> np.ndarray:
        order = s.argsort(-1)[..., ::-1]
        out = np.empty(s.shape)
        np.put_along_axis(out, order, np.broadcast_to(np.arange(1, s.shape[-1] + 1, dtype=float), s.shape), -1)
        return out

    def percentiles(s: np.ndarray) -> np.ndarray:
        n = s.shape[-1]
        return 1 - (places(np.round(s, 12)) - 1) / max(n - 1, 1)

    def run(key: tuple, g: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=["course_id", "k", "rank", "rank_low", "rank_high", "level"])
        w = g.pivot_table(index="k", columns="member", values="weight", fill_value=0.0).sort_index()
        r = g.pivot_table(index="k", columns="member", values="rank", fill_value=0.0).sort_index()
        one = g.drop_duplicates("k").set_index("k").loc[w.index]
        rng = np.random.default_rng((seed, abs(int(key[0]))))
        weight, rank, names = w.to_numpy(), r.to_numpy(), list(w.columns)
        base = places((weight * rank).sum(1))
        mean, kappa, ratio = one["mean"].fillna(0.4).to_numpy(), one["kappa"].fillna(2.0).to_numpy(), one["variance_ratio"].fillna(1.0).to_numpy()
        y = past.pivot_table(index="t", columns="k", values="y", aggfunc="max", fill_value=0).reindex(columns=w.index, fill_value=0).to_numpy(float)
        n = len(y)
        at = names.index("beta_binomial") if "beta_binomial" in names else None
        mid = weight.mean(0)
        shape = np.maximum(mid / max(mid.sum(), 1e-12) * (2 + 4 * max(n - 1, 0)), 1e-3)
        samples = []
        for _ in range(draws):
            scale = rng.dirichlet(shape) / np.maximum(mid / max(mid.sum(), 1e-12), 1e-9)
            now, mine = weight * scale, rank
            if at is not None:
                mine = rank.copy()
                total = kappa + n
                mine[:, at] = percentiles(rng.beta(np.maximum(mean * total, 1e-3), np.maximum((1 - mean) * total, 1e-3)))
            samples.append(places((now * mine).sum(1) / np.maximum(now.sum(1), 1e-12)))
        jack = [base]
        for j in range(n if at is not None and n > 1 else 0):
            rest = np.delete(y, j, 0)
            a, b, _, _ = posterior(rest.sum(0), float(len(rest)), None)
            mine = rank.copy()
            mine[:, at] = percentiles(a / (a + b))
            jack.append(places((weight * mine).sum(1)))
        low = np.minimum(np.min(jack, 0), np.percentile(samples, 10, axis=0))
        high = np.maximum(np.max(jack, 0), np.percentile(samples, 90, axis=0))
        wide = (high - low) / len(w)
        level = np.where(wide < 0.2, "Low", np.where(wide < 0.4, "Medium", "High"))
        level = np.where(ratio >= 0.75, "High", np.where((ratio >= 0.5) & (level == "Low"), "Medium", level))
        return pd.DataFrame({"course_id": key[0], "k": w.index.to_numpy(), "rank": base.astype(int), "rank_low": np.floor(low).astype(int), "rank_high": np.ceil(high).astype(int), "level": level})

    x = shares.join(post, ["course_id", "k"], "left")
    return x.groupBy("course_id").cogroup(cells.select("course_id", "k", "t", "y").groupBy("course_id")).applyInPandas(run, "course_id long, k long, rank int, rank_low int, rank_high int, level string")


def simulate_courses(spark, n: int, seed: int = 20241) -> DataFrame:
    """course_id, t, k, unit, y of n invented courses of 8 to 36 items over 3 to 24 exams.

    Every item has a rate of its own about its course's and its unit's, and one of six habits, mixed anew for each course:
    none, persistence or avoidance, rotation, trend, a pause after an appearance, hot and cold phases. An exam holds at
    least one item."""

    def course(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        items, steps, units = int(rng.integers(8, 37)), int(rng.integers(3, 25)), int(rng.integers(2, 8))
        unit, base = rng.integers(0, units, items), rng.uniform(0.15, 0.65)
        level = math.log(base / (1 - base)) + rng.normal(0, rng.uniform(0.3, 2.0), items) + rng.normal(0, 0.5, units)[unit]
        habit = rng.choice(6, items, p=rng.dirichlet(np.full(6, 0.7)))
        rho, period, phase = rng.uniform(-2, 2, items), rng.choice([2, 3, 4], items), rng.integers(0, 4, items)
        swing, slope, pause = rng.uniform(1, 3, items), rng.normal(0, 0.25, items), rng.uniform(1, 3, items)
        turn, heat, hot = rng.uniform(0.05, 0.3, items), rng.uniform(1, 2.5, items), rng.random(items) < 0.5
        y, absent = np.zeros((steps, items), np.int64), np.zeros(items)
        for t in range(steps):
            last = y[t - 1] > 0 if t else np.zeros(items, bool)
            hot = np.where(rng.random(items) < turn, ~hot, hot)
            shift = [
                0 * level, np.where(last, rho, -0.3 * rho) if t else 0 * level, np.where((t + phase) % period == 0, swing, -swing), slope * (t - steps / 2),
                np.where(last, -pause, np.where(absent >= 2, 0.5 * pause, 0)) if t else 0 * level, np.where(hot, heat, -heat),
            ]
            odds = level + np.choose(habit, shift)
            y[t] = rng.random(items) < 1 / (1 + np.exp(-odds))
            if not y[t].any():
                y[t, int(odds.argmax())] = 1
            absent = np.where(y[t] > 0, 0, absent + 1)
        return y, unit

    def run(batches):
        for pdf in batches:
            out = []
            for cid in pdf["id"]:
                y, unit = course(np.random.default_rng((seed, int(cid))))
                steps, items = y.shape
                out.append(pd.DataFrame({"course_id": int(cid), "t": np.repeat(np.arange(steps, dtype=np.int32), items), "k": np.tile(np.arange(items), steps), "unit": np.tile(unit, steps), "y": y.ravel()}))
            yield pd.concat(out) if out else pd.DataFrame({"course_id": [], "t": [], "k": [], "unit": [], "y": []})

    return spark.range(n).mapInPandas(run, "course_id long, t int, k long, unit long, y long")
