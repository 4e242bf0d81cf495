"""The ensemble's walk through a course: folds, choices, weights and shares at every cutoff, from earlier folds alone.

A course is one small block of numbers (models by cutoffs by items), so it is walked in one pass in numpy. The same steps as
DataFrames are running_choice(), running_first() and fold_metrics() in metrics, evidence_weights() and gated_ensemble() in
members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import members as B
from chronopanel.operators import metrics as M
from chronopanel.operators.models import in_groups

SCHEMA = "what string, course_id long, k long, cutoff int, model string, a double, b double, c double, n long"


def facts(past: DataFrame, doubt: DataFrame, top_k: DataFrame, exams: DataFrame, quality: DataFrame) -> DataFrame:
    """course_id, k, cutoff, model, score: what the walk needs beside scores, as models whose names begin
    with ~. doubt: course_id, k, cutoff, variance_ratio of every row that has features."""
    e = exams.groupBy("course_id", "t").agg(F.max(F.col("year").isNull().cast("int")).alias("u"))
    e = e.select("course_id", (F.col("t") + 1).cast("int").alias("cutoff"), (1 - 0.5 * F.col("u")).alias("score"))
    row = lambda df, name, score: df.select("course_id", "k" if "k" in df.columns else F.lit(None).cast("long").alias("k"), "cutoff", (name if not isinstance(name, str) else F.lit(name)).alias("model"), F.col(score).cast("double").alias("score"))
    truth = row(past.withColumnRenamed("t", "cutoff"), "~rel", "y")
    parts = [truth, row(doubt, "~ratio", "variance_ratio"), row(top_k.withColumn("cutoff", F.lit(0)), "~top_k", "top_k"), row(e, "~exams", "score"), row(quality, F.concat(F.lit("~q_"), "member"), "quality")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def percentiles(s: np.ndarray) -> np.ndarray:
    """average_percentile() of an array."""
    if len(s) <= 1:
        return np.full(len(s), 0.5)
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    first = np.cumsum(n) - n
    return (first + (n - 1) / 2)[at] / (len(s) - 1)


def ndcg(score: np.ndarray, rel: np.ndarray, top_k: int) -> float:
    """Of scores in the order of items, ties by item; NaN where nothing is relevant."""
    if not rel.any():
        return np.nan
    best = np.argsort(-score, kind="stable")[:top_k]
    disc = 1 / np.log2(np.arange(2, max(top_k, 1) + 2))
    return float((rel[best] * disc[: len(best)]).sum() / disc[: min(int(rel.sum()), top_k)].sum())


def walk(rows: DataFrame, tuned: dict, single: list[str], want: tuple[str, ...], tau: float = 2.0, shrink: float = 3.0, least: float = 0.05) -> DataFrame:
    """SCHEMA rows of each thing wanted: fold (a: ndcg), weight (a: reliability, b: skill, c: weight, n: folds), share (a:
    weight, b: rank, c: share), score (a; of chosen models and the ensemble), ablation (a: ndcg of the ensemble without a
    member). rows: course_id, k, cutoff, model, score of the models and of facts()."""
    bound = np.array([np.nan, np.nan, *[M.t_quantile(0.95, i) for i in range(1, 200)]])
    members, outside, df = list(B.DEGREES), set(B.OUTSIDE), dict(B.DEGREES)
    sets = {"all": members} | {f"without_{m}": [x for x in members if x != m] for m in members}

    def course(g: pd.DataFrame) -> list[pd.DataFrame]:
        cid, out = g["course_id"].iloc[0], []
        # A course without top_k has no exam that holds an item, and no folds.
        kind = {m: x for m, x in g.groupby("model", sort=False)}
        top = kind.get("~top_k")
        ratio = kind["~ratio"] if "~ratio" in kind else g.iloc[:0]
        cutoffs, items = np.unique(ratio["cutoff"]), np.unique(g.loc[g["k"].notna(), "k"].astype("int64"))

        def grid(x: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
            v, there = np.full((len(cutoffs), len(items)), np.nan), np.zeros((len(cutoffs), len(items)), bool)
            if x is not None and len(cutoffs):
                x = x[x["cutoff"].isin(cutoffs)]
                c, i = np.searchsorted(cutoffs, x["cutoff"]), np.searchsorted(items, x["k"].astype("int64"))
                v[c, i], there[c, i] = x["score"], True
            return v, there

        rel, known = grid(kind.get("~rel"))
        doubt = np.where(np.isnan(d := grid(ratio)[0]), 1.0, d)
        score = {m: grid(x) for m, x in kind.items() if not m.startswith("~")}
        exams = kind.get("~exams", g.iloc[:0])

        def fold(v: np.ndarray, there: np.ndarray, c: int) -> float:
            on = there & known[c]
            return ndcg(np.round(np.where(np.isnan(v), -np.inf, v)[on], 12), rel[c][on], int(top["score"].iloc[0])) if top is not None and on.any() else np.nan

        def add(what: str, c: int, model, k=None, /, **values) -> None:
            out.append(pd.DataFrame({"what": what, "course_id": cid, "k": pd.array(k if k is not None else [None] * len(model), dtype="Int64"), "cutoff": int(cutoffs[c]), "model": model, **{x: values.get(x) for x in ("a", "b", "c", "n")}}))

        folds = {m: np.array([fold(v[c], t[c], c) for c in range(len(cutoffs))]) for m, (v, t) in score.items()}
        # Tuned models: the variant that led the default on earlier folds beyond the t bound.
        for name, (variants, default) in tuned.items():
            none = np.full(len(cutoffs), np.nan)
            v, there, f = np.full(rel.shape, np.nan), np.zeros(rel.shape, bool), none.copy()
            others = [x for x in variants if x != default]
            diff = np.array([folds.get(x, none) - folds.get(default, none) for x in others])
            for c in range(len(cutoffs)):
                past = [d[:c][~np.isnan(d[:c])] for d in diff]
                mean = [round(float(d.mean()), 12) if len(d) else -9.0 for d in past]
                i = int(np.argmax(mean))
                n = len(past[i])
                chosen = others[i] if mean[i] > 1e-12 and n >= 2 and mean[i] > bound[min(n, 200)] * past[i].std(ddof=1) / np.sqrt(n) else default
                if chosen in score:
                    v[c], there[c], f[c] = score[chosen][0][c], score[chosen][1][c], folds[chosen][c]
            score[name], folds[name] = (v, there), f
        extra = list(tuned)
        # The single method with the best mean on earlier folds, by name among equals.
        v, there, f = np.full(rel.shape, np.nan), np.zeros(rel.shape, bool), np.full(len(cutoffs), np.nan)
        for c in range(len(cutoffs)):
            mean = {m: round(float(np.nanmean(folds[m][:c])), 12) for m in sorted(single) if m in folds and not np.isnan(folds[m][:c]).all()} if c else {}
            chosen = max(mean, key=lambda m: mean[m]) if mean else "beta_binomial"  # noqa: B023
            if chosen in score:
                v[c], there[c], f[c] = score[chosen][0][c], score[chosen][1][c], folds[chosen][c]
        score["best_single"], folds["best_single"] = (v, there), f
        # Weights by reliability and by skill on earlier folds.
        m_folds = np.array([folds.get(m, np.full(len(cutoffs), np.nan)) for m in members])
        count = (~np.isnan(m_folds)).sum(0)
        d = np.where(count >= 2, m_folds - np.nansum(m_folds, 0) / np.maximum(count, 1), np.nan)
        ensemble, there_e, f_e = np.full(rel.shape, np.nan), np.zeros(rel.shape, bool), np.full(len(cutoffs), np.nan)
        step, size = exams["cutoff"].to_numpy(), exams["score"].to_numpy()
        quality = {m: dict(zip(x["cutoff"], x["score"], strict=True)) for m in members if (x := kind.get(f"~q_{m}")) is not None}
        for c, cut in enumerate(cutoffs):
            here = [m for m in members if m in score and score[m][1][c].any()]
            if not here:
                continue
            past = d[:, :c]
            every = past[~np.isnan(past)]
            sd = max(np.sqrt(max((every**2).mean() - every.mean() ** 2, 0.0)) if len(every) > 1 else 0.0, least)
            n_exams = size[step <= cut].sum() if (step == cut).any() else 0.0
            n_folds = np.array([(~np.isnan(past[members.index(m)])).sum() for m in here])
            raw = np.array([np.nansum(past[members.index(m)]) for m in here]) / np.maximum(n_folds, 1)
            skill = np.where(n_folds > 0, raw / sd * (n_folds / (n_folds + shrink)), 0.0)
            more = np.array([float(m in outside and m != "semantic") for m in here])
            free = np.array([df[m] for m in here])
            q = np.array([quality.get(m, {}).get(cut, 1.0) for m in here])
            rho = np.where(np.isnan(q), 1.0, q) * np.where(free <= 0, 1.0, (n_exams + more) / np.maximum(n_exams + more + free, 1e-300))
            base = rho * np.exp(tau * skill)
            weight = base / base.sum()
            if "weight" in want:
                add("weight", c, here, a=rho, b=skill, c=weight, n=n_folds)
            rank, gate = np.zeros((len(here), len(items))), np.zeros((len(here), len(items)))
            for i, m in enumerate(here):
                v, on = score[m][0][c], score[m][1][c]
                rank[i, on] = percentiles(np.round(np.where(np.isnan(v[on]), -np.inf, v[on]), 12))
                gate[i, on] = weight[i] * ((1 + doubt[c, on]) if m in outside else 1.0)
            there_e[c] = gate.sum(0) > 0
            gate = gate / np.where(there_e[c], gate.sum(0), 1.0)
            ensemble[c] = (gate * rank).sum(0)
            f_e[c] = fold(ensemble[c], there_e[c], c)
            if "share" in want:
                i, k = np.nonzero(np.array([score[m][1][c] for m in here]))
                add("share", c, np.array(here, object)[i], items[k], a=gate[i, k], b=rank[i, k], c=(gate * rank)[i, k])
            if "ablation" in want:
                names, found = [], []
                for name, kept in sets.items():
                    on = np.array([m in kept for m in here])
                    total = gate[on].sum(0)
                    value = fold((gate * rank)[on].sum(0) / np.where(total > 0, total, 1.0), total > 0, c)
                    if not np.isnan(value):
                        names.append(name)
                        found.append(value)
                if names:
                    add("ablation", c, names, a=found)
        score["ensemble"], folds["ensemble"] = (ensemble, there_e), f_e
        if "fold" in want:
            for c in range(len(cutoffs)):
                if names := [m for m, f in folds.items() if not np.isnan(f[c])]:
                    add("fold", c, names, a=[folds[m][c] for m in names])
        if "score" in want:
            for m in (*extra, "best_single", "ensemble"):
                v, on = score[m]
                for c in range(len(cutoffs)):
                    if on[c].any():
                        add("score", c, [m] * int(on[c].sum()), items[on[c]], a=v[c][on[c]])
        return out

    def fit(x: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        start = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        parts = [p for a, b in zip(start[:-1], start[1:], strict=True) for p in course(x.iloc[a:b])]
        return pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")})

    return in_groups(rows.select("course_id", "k", "cutoff", "model", "score"), ("course_id",), fit, SCHEMA)
