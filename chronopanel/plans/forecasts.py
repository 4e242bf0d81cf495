"""Queries of features, scores, folds and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import features as X
from chronopanel.operators import metrics as M
from chronopanel.operators import panel as P
from chronopanel.operators.hierarchy import latest
from chronopanel.plans.panels import _HAZ, PANEL, cells, observations, rounded, units  # noqa: F401
from chronopanel.sources.tables import cut, drop_cut, table


def _history(spark, d):
    return X.history_features(cells(spark, d, True)).where("cutoff > 0")


def statics(spark, d):
    nodes = latest(table(spark, d, "tree"), "node_id", "loaded_at", ["title", "hours", "marks_weight", "concepts"])
    return X.item_statics(P.mappings_once(table(spark, d, "mappings")), observations(spark, d), nodes)


def features(spark, d):
    """All features, written once: they feed every model."""
    c = cut(cells(spark, d, True))
    st, un = cut(statics(spark, d)), cut(units(spark, d))
    made = []
    out = cut(X.all_features(c, P.cell_formats(observations(spark, d)), st, X.item_similarity(st), un, made))
    for df in made:
        drop_cut(df)
    return out


_SIMPLE = ["frequency", "last_exam", "window3", "ewma_15", "linear_decay", "freq_recency", "bayes"]


def simple_scores(spark, d):
    """Scores of the models that need history alone: no join beyond the panel's own."""
    h = _history(spark, d)
    f = F.col
    p = lambda c: P.average_percentile(F.col(c), "course_id", "cutoff")
    wide = h.select(
        "course_id", "k", "cutoff", (f("freq_all") + 1e-3 * f("ewma_short")).alias("frequency"), (f("last1") + 0.1 * f("freq_all")).alias("last_exam"), (f("freq_last3") + 1e-3 * f("freq_all")).alias("window3"),
        (f("ewma_short") + 1e-4 * f("freq_all")).alias("ewma_15"), f("linear_decay").alias("linear_decay"), ((p("freq_all") + p("ewma_short")) / 2).alias("freq_recency"), f("bayes_mean").alias("bayes"),
    )
    wide = wide.select("course_id", "k", "cutoff", *[F.round(c, 9).alias(c) for c in _SIMPLE])  # ties are ties in any engine
    return wide.unpivot(["course_id", "k", "cutoff"], _SIMPLE, "model", "score")


def simple_folds(spark, d):
    c = cells(spark, d)
    return M.fold_metrics(M.with_truth(simple_scores(spark, d), c), P.resolve_top_k(c))


def _tuned(spark, d):
    return M.tuned_choice(simple_folds(spark, d), "ndcg", ["window3", "ewma_15", "linear_decay", "bayes"], "frequency")


def _probabilities(spark, d):
    s = simple_scores(spark, d).where("model in ('frequency', 'bayes')")
    t = M.with_truth(s, cells(spark, d))
    return t.select("course_id", "k", "cutoff", "model", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("p"), F.col("rel").alias("y"))


def _leakage(spark, d):
    """Models whose scores at a cutoff change when that exam and all later ones are turned upside down: none should.

    Every course is cut at half its exams."""
    c = cut(cells(spark, d, True))
    end = c.groupBy("course_id").agg(F.floor((F.max("t") + 1) / 2).cast("int").alias("at"))
    flip = c.join(end, "course_id")
    late = F.col("t") >= F.col("at")
    bad = flip.select("course_id", "t", "k", *[F.when(late, 1 - F.col(x) if x == "y" else F.col(x) * 3 + 1).otherwise(F.col(x)).alias(x) for x in P.CELL_SUMS])

    def at_cut(x):
        h = X.history_features(x).join(X.timing_features(x), ["course_id", "k", "cutoff"]).join(X.cooccurrence_feature(x), ["course_id", "k", "cutoff"])
        h = h.join(end, "course_id").where("cutoff = at and cutoff > 0")
        keep = [n for n, t in h.dtypes if t == "double"]
        return h.select("course_id", "k", *[F.round(F.coalesce(n, F.lit(0.0)), 9).alias(n) for n in keep]).unpivot(["course_id", "k"], keep, "feature", "value")

    a, b = at_cut(c), at_cut(bad).withColumnRenamed("value", "other")
    return a.join(b, ["course_id", "k", "feature"]).groupBy("feature").agg(F.count(F.when(F.col("value") != F.col("other"), 1)).alias("changed"), F.count("*").alias("compared"))


QUERIES = {
    "features_history": lambda s, d: rounded(_history(s, d).select("course_id", "k", "cutoff", "freq_all", "count_log", "last1", "freq_last3", "freq_last5", "ewma_short", "ewma_long", "linear_decay", "soft_ewma", "soft_mean", "sem_ewma", "sem_density", "hist_log", "base_rate", "bayes_mean", "bayes_width")),
    "features_timing": lambda s, d: rounded(X.timing_features(cells(s, d, True)).where("cutoff > 0")),
    "features_types": lambda s, d: rounded(X.type_features(cells(s, d, True), P.cell_formats(observations(s, d))).where("cutoff > 0")),
    "features_cooccurrence": lambda s, d: rounded(X.cooccurrence_feature(cells(s, d, True)).where("cutoff > 0")),
    "features_statics": lambda s, d: rounded(statics(s, d).select("course_id", "k", "hours_share", "marks_weight_share", "breadth")),
    "item_similarity": lambda s, d: rounded(X.item_similarity(statics(s, d))),
    "training_rows": lambda s, d: P.training_rows(_history(s, d).select("course_id", "k", "cutoff", "n", "steps")).groupBy("course_id", "target").agg(F.count("*").alias("rows"), F.sum("n").alias("n_sum")),
    "simple_scores": lambda s, d: rounded(simple_scores(s, d)),
    "percentile_rank": lambda s, d: rounded(P.mappings_once(table(s, d, "mappings")).select("question_id", "k", P.average_percentile(F.col("score"), "k").alias("pct"))),
    "fold_metrics": lambda s, d: rounded(simple_folds(s, d)),
    "random_expectations": lambda s, d: rounded(M.random_expectations(cells(s, d), P.resolve_top_k(cells(s, d)))),
    "mean_and_se": lambda s, d: rounded(M.mean_and_se(simple_folds(s, d), "ndcg", "model")),
    "paired_tests": lambda s, d: rounded(M.paired(simple_folds(s, d), "ndcg", "frequency")),
    "running_best": lambda s, d: rounded(M.running_best(simple_folds(s, d).withColumn("precision", F.round("precision", 9)), "precision")),
    "tuned_choice": _tuned,
    "one_se_rule": lambda s, d: rounded(M.select_by_one_se(simple_folds(s, d), "ndcg", _SIMPLE)),
    "leakage_audit": _leakage,
    "reliability_bins": lambda s, d: rounded(M.reliability(_probabilities(s, d).withColumn("p", F.round("p", 9)))),
    "brier_log_loss": lambda s, d: rounded(_probabilities(s, d).groupBy("model").agg(M.brier().alias("brier"), M.log_loss().alias("log_loss"), F.count("*").alias("n"))),
}

_H = PANEL + """, ew AS (SELECT course_id, k, cutoff, sum(y) AS n, count(*) AS steps, avg(y) AS freq_all, avg(y) FILTER (WHERE t >= cutoff - 1) AS last1, avg(y) FILTER (WHERE t >= cutoff - 3) AS freq_last3,
  avg(y) FILTER (WHERE t >= cutoff - 5) AS freq_last5, sum(y * pow(0.5, (cutoff - 1 - t) / 1.5)) / sum(pow(0.5, (cutoff - 1 - t) / 1.5)) AS ewma_short,
  sum(y * pow(0.5, (cutoff - 1 - t) / 6.0)) / sum(pow(0.5, (cutoff - 1 - t) / 6.0)) AS ewma_long, sum(y * (t + 1)) / sum(t + 1) AS linear_decay,
  sum(soft * pow(0.5, (cutoff - 1 - t) / 6.0)) / sum(pow(0.5, (cutoff - 1 - t) / 6.0)) AS soft_ewma, avg(soft) AS soft_mean,
  sum(semantic * pow(0.5, (cutoff - 1 - t) / 6.0)) / sum(pow(0.5, (cutoff - 1 - t) / 6.0)) AS sem_ewma, avg((semantic >= 0.2)::INT) AS sem_density FROM hist GROUP BY ALL),
bs AS (SELECT course_id, cutoff, sum(n) / sum(steps) AS base_rate FROM ew GROUP BY ALL),
hf AS (SELECT ew.*, base_rate, (n + 4 * base_rate) / (steps + 4) AS bayes_mean FROM ew JOIN bs USING (course_id, cutoff))
"""
_SC = _H + """, pc AS (SELECT *, CASE WHEN count(*) OVER g <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY course_id, cutoff ORDER BY freq_all) - 1 + (count(*) OVER (PARTITION BY course_id, cutoff, freq_all) - 1) / 2) / (count(*) OVER g - 1) END AS pf,
  CASE WHEN count(*) OVER g <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY course_id, cutoff ORDER BY round(ewma_short, 12)) - 1 + (count(*) OVER (PARTITION BY course_id, cutoff, round(ewma_short, 12)) - 1) / 2) / (count(*) OVER g - 1) END AS pe
  FROM hf WINDOW g AS (PARTITION BY course_id, cutoff)),
sw AS (SELECT course_id, k, cutoff, round(freq_all + 1e-3 * ewma_short, 9) AS frequency, round(last1 + 0.1 * freq_all, 9) AS last_exam, round(freq_last3 + 1e-3 * freq_all, 9) AS window3, round(ewma_short + 1e-4 * freq_all, 9) AS ewma_15,
  round(linear_decay, 9) AS linear_decay, round((pf + pe) / 2, 9) AS freq_recency, round(bayes_mean, 9) AS bayes FROM pc),
sl AS (UNPIVOT sw ON frequency, last_exam, window3, ewma_15, linear_decay, freq_recency, bayes INTO NAME model VALUE score)
"""
_FM = _SC + """, tk AS (SELECT course_id, least(greatest(least(round_even(median(n), 0), 15), 3), any_value(size)) AS top_k FROM (SELECT course_id, t, sum(y) AS n FROM cells GROUP BY ALL HAVING sum(y) > 0) JOIN (SELECT course_id, count(*) AS size FROM items GROUP BY 1) USING (course_id) GROUP BY course_id),
tr AS (SELECT course_id, k, t AS cutoff, y AS rel, CASE WHEN y = 0 THEN 0 WHEN sum(marks) OVER c > 0 AND marks > 0 THEN marks / sum(marks) OVER c ELSE 1.0 / sum(y) OVER c END AS gain FROM cells WINDOW c AS (PARTITION BY course_id, t)),
rk AS (SELECT sl.*, rel, gain, top_k, row_number() OVER (PARTITION BY course_id, model, cutoff ORDER BY score DESC, k) AS rank, row_number() OVER (PARTITION BY course_id, model, cutoff ORDER BY rel DESC, k) AS ideal,
  row_number() OVER (PARTITION BY course_id, model, cutoff ORDER BY gain DESC, k) AS ideal_gain FROM sl JOIN tr USING (course_id, k, cutoff) JOIN tk USING (course_id)),
rc AS (SELECT *, sum(rel) OVER (PARTITION BY course_id, model, cutoff ORDER BY rank) AS cum FROM rk),
fm AS (SELECT course_id, model, cutoff, sum(rel)::BIGINT AS relevant, sum(rel) FILTER (WHERE rank <= top_k) / any_value(top_k) AS precision, sum(rel) FILTER (WHERE rank <= top_k) / sum(rel) AS recall,
  (sum(rel) FILTER (WHERE rank <= top_k) > 0)::INT AS hit, sum(rel / log2(rank + 1)) FILTER (WHERE rank <= top_k) / sum(rel / log2(ideal + 1)) FILTER (WHERE ideal <= top_k) AS ndcg,
  sum(gain / log2(rank + 1)) FILTER (WHERE rank <= top_k) / sum(gain / log2(ideal_gain + 1)) FILTER (WHERE ideal_gain <= top_k) AS ndcg_marks, 1 / min(rank) FILTER (WHERE rel > 0) AS mrr,
  sum(cum / rank) FILTER (WHERE rel > 0) / sum(rel) AS average_precision, max(rel) FILTER (WHERE rank <= 1) AS hit_1, max(rel) FILTER (WHERE rank <= 3) AS hit_3, max(rel) FILTER (WHERE rank <= 5) AS hit_5, max(rel) FILTER (WHERE rank <= 10) AS hit_10
  FROM rc GROUP BY ALL HAVING sum(rel) > 0)
"""
_TQ = "[" + ", ".join(f"{M.t_quantile(0.95, i)!r}" for i in range(1, 200)) + "]"
_TIME = PANEL + """, nx AS (SELECT a.course_id, a.k, a.t AS c, b.t, b.y, lag(b.t) OVER w AS pt, lag(b.y) OVER w AS py, max(CASE WHEN b.y > 0 THEN b.t END) OVER (PARTITION BY a.course_id, a.k, a.t ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po
    FROM cellsf a JOIN cells b ON a.course_id = b.course_id AND a.k = b.k AND b.t < a.t WHERE a.t > 0 WINDOW w AS (PARTITION BY a.course_id, a.k, a.t ORDER BY b.t)),
s AS (SELECT course_id, k, c, max(CASE WHEN y > 0 THEN t END) AS one, max(CASE WHEN y = 0 THEN t END) AS nil, sum(y) AS n, count(*) AS steps, avg(CASE WHEN y > 0 THEN t - po END) AS mg0, stddev_samp(CASE WHEN y > 0 THEN t - po END) AS sd0,
    count(*) FILTER (WHERE py = 0 AND y = 0) AS n00, count(*) FILTER (WHERE py = 0 AND y = 1) AS n01, count(*) FILTER (WHERE py = 1 AND y = 0) AS n10, count(*) FILTER (WHERE py = 1 AND y = 1) AS n11, arg_max(y, t) AS ly,
    regr_slope(y, t) FILTER (WHERE t >= c - 6) AS slope, count(*) FILTER (WHERE t >= c - 6) AS m6 FROM nx GROUP BY ALL),
p AS (SELECT *, coalesce(avg(mg0) OVER g, greatest(steps / 2, 1)) AS pool, (sum(n01) OVER g + 1e-9) / (sum(n00) OVER g + sum(n01) OVER g + 2e-9) AS p0, (sum(n11) OVER g + 1e-9) / (sum(n10) OVER g + sum(n11) OVER g + 2e-9) AS p1 FROM s WINDOW g AS (PARTITION BY course_id, c)),
f AS (SELECT *, coalesce(mg0, CASE WHEN n > 0 THEN steps / n END, pool) AS mg, coalesce(c - one, c + 1) AS since, CASE WHEN n > 0 THEN least(c - one, 6) ELSE 0 END AS gap FROM p), f2 AS (SELECT *, coalesce(sd0, mg) AS sd FROM f),
bs AS (SELECT a.course_id, a.c, avg(b.y) AS base FROM (SELECT DISTINCT course_id, t AS c FROM cellsf WHERE t > 0) a JOIN cells b ON a.course_id = b.course_id AND b.t < a.c GROUP BY ALL),
hz AS (SELECT course_id, c, coalesce(least(t - po, 6), 0) AS gap, sum(y) AS hits, count(*) AS opps FROM nx WHERE t > 0 GROUP BY ALL)
"""
_R = lambda *cols: ", ".join(f"round({c} + 1e-10, 6) AS {c}" for c in cols)
ORACLES = {
    "features_timing": _TIME
    + """SELECT f2.course_id, f2.k, f2.c AS cutoff, round(least(since, 10) / 10 + 1e-10, 6) AS since_last, (n = 0)::INT::DOUBLE AS never_seen, round(CASE WHEN coalesce(one, -1) > coalesce(nil, -1) THEN least(f2.c - 1 - coalesce(nil, -1), 6) / 6 ELSE 0 END + 1e-10, 6) AS streak_present,
    round(CASE WHEN coalesce(nil, -1) > coalesce(one, -1) THEN least(f2.c - 1 - coalesce(one, -1), 10) / 10 ELSE 0 END + 1e-10, 6) AS streak_absent, round(least(mg, 10) / 10 + 1e-10, 6) AS mean_gap, round(least(greatest(sd / mg, 0), 3) + 1e-10, 6) AS gap_cv,
    round(least(greatest((CASE WHEN n > 0 THEN since ELSE steps + 1 END - mg) / (sd + 1), -3), 3) + 1e-10, 6) AS due_z, round(CASE WHEN ly > 0 THEN (n11 + 2 * p1) / (n10 + n11 + 2) ELSE (n01 + 2 * p0) / (n00 + n01 + 2) END + 1e-10, 6) AS markov_next,
    round(CASE WHEN m6 >= 3 THEN least(greatest(coalesce(slope, 0), -0.5), 0.5) ELSE 0 END + 1e-10, 6) AS trend, round(coalesce((hz.hits + 3 * base) / (hz.opps + 3), base) + 1e-10, 6) AS hazard
    FROM f2 JOIN bs ON bs.course_id = f2.course_id AND bs.c = f2.c LEFT JOIN hz ON hz.course_id = f2.course_id AND hz.c = f2.c AND hz.gap = f2.gap""",
    "features_cooccurrence": PANEL
    + """, sn AS (SELECT course_id, t, k FROM cells WHERE y > 0), l AS (SELECT course_id, t + 1 AS c, k AS j FROM sn), nj AS (SELECT l.course_id, l.c, l.j, count(s.t) AS n FROM l LEFT JOIN sn s ON s.course_id = l.course_id AND s.k = l.j AND s.t + 1 < l.c GROUP BY ALL),
    b AS (SELECT course_id, k, cutoff AS c, avg(y) AS base FROM hist GROUP BY ALL), fo AS (SELECT x.course_id, x.k AS j, z.k, z.t FROM sn x JOIN sn z ON x.course_id = z.course_id AND z.t = x.t + 1),
    pr AS (SELECT b.course_id, b.k, b.c, b.base, nj.j, nj.n, count(fo.t) AS hits FROM b JOIN nj ON nj.course_id = b.course_id AND nj.c = b.c LEFT JOIN fo ON fo.course_id = b.course_id AND fo.j = nj.j AND fo.k = b.k AND fo.t < b.c GROUP BY ALL),
    li AS (SELECT course_id, k, c, avg((hits + 2 * base) / (n + 2)) / (any_value(base) + 1e-6) AS lift FROM pr GROUP BY ALL)
    SELECT b.course_id, b.k, b.c AS cutoff, round(CASE WHEN lift IS NULL THEN 0 ELSE ln(greatest(lift, 1e-3)) END + 1e-10, 6) AS cooc_lift_last FROM b LEFT JOIN li USING (course_id, k, c)""",
    "tuned_choice": _FM
    + f""", df AS (SELECT a.course_id, a.cutoff, a.model, a.ndcg - b.ndcg AS d FROM fm a JOIN fm b ON a.course_id = b.course_id AND a.cutoff = b.cutoff AND b.model = 'frequency' WHERE a.model IN ('window3', 'ewma_15', 'linear_decay', 'bayes')), c AS (SELECT DISTINCT course_id, cutoff FROM fm),
    p AS (SELECT c.course_id, c.cutoff, model, avg(d) AS m, stddev_samp(d) AS s, count(*) AS n FROM c JOIN df ON df.course_id = c.course_id AND df.cutoff < c.cutoff GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY course_id, cutoff ORDER BY m DESC, model DESC) AS r FROM p WHERE n >= 2 AND m > {_TQ}[least(n - 1, 199)] * s / sqrt(n))
    SELECT course_id, cutoff, coalesce(model, 'frequency') AS model FROM c LEFT JOIN (SELECT * FROM g WHERE r = 1) USING (course_id, cutoff)""",
    "one_se_rule": _FM
    + f", s AS (SELECT model, avg(ndcg) AS mean, stddev_samp(ndcg) / sqrt(count(*)) AS se FROM fm GROUP BY 1), b AS (SELECT mean, se FROM s ORDER BY mean DESC, model DESC LIMIT 1) SELECT s.model, round(s.mean + 1e-10, 6) AS mean FROM s, b WHERE s.mean >= b.mean - b.se ORDER BY list_position({_SIMPLE}, s.model) LIMIT 1",
    "supporting_signals": _H
    + """, ms AS (SELECT a.course_id, a.k, a.t AS cutoff, coalesce(avg(CASE WHEN b.y > 0 THEN b.share END), 0) AS marks_share FROM cellsf a JOIN (SELECT *, marks / greatest(sum(marks) OVER (PARTITION BY course_id, t), 1e-9) AS share FROM cells) b ON a.course_id = b.course_id AND a.k = b.k AND b.t < a.t GROUP BY ALL),
    z AS (SELECT hf.*, marks_share, median(sem_ewma) OVER (PARTITION BY course_id, cutoff) AS med FROM hf JOIN ms USING (course_id, k, cutoff)), w AS (SELECT course_id, k, cutoff, list_filter([CASE WHEN freq_all >= 0.5 THEN 'frequency' END, CASE WHEN round(ewma_short, 9) >= 0.5 THEN 'recency' END, CASE WHEN sem_ewma >= med AND sem_ewma > 0 THEN 'semantic' END, CASE WHEN round(marks_share, 9) >= 0.1 THEN 'marks' END], lambda v: v IS NOT NULL) AS l FROM z)
    SELECT course_id, k, cutoff, coalesce(array_to_string(l, ', '), '') AS signals, len(l) AS n FROM w""",
    "features_history": _H
    + "SELECT course_id, k, cutoff, "
    + _R("freq_all", "last1", "freq_last3", "freq_last5", "ewma_short", "ewma_long", "linear_decay", "soft_ewma", "soft_mean", "sem_ewma", "sem_density", "base_rate", "bayes_mean")
    + ", round(ln(1 + n) + 1e-10, 6) AS count_log, round(ln(1 + steps) + 1e-10, 6) AS hist_log, round(2 * 1.2816 * sqrt((n + 4 * base_rate) * (steps - n + 4 * (1 - base_rate)) / (pow(steps + 4, 2) * (steps + 5))) + 1e-10, 6) AS bayes_width FROM hf",
    "features_types": PANEL
    + """, f AS (SELECT c.course_id, c.k, c.t AS cutoff, o.format, count(o.question_id) AS n FROM cellsf c LEFT JOIN obs o ON o.course_id = c.course_id AND o.k = c.k AND o.t < c.t WHERE c.t > 0 GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY course_id, k, cutoff) AS total FROM f)
    SELECT course_id, k, cutoff, round(coalesce(sum(n / total) FILTER (WHERE format = 'numerical'), 0) + 1e-10, 6) AS numerical_share, round(coalesce(sum(n / total) FILTER (WHERE format = 'derivation'), 0) + 1e-10, 6) AS derivation_share,
    round(coalesce(sum(n / total) FILTER (WHERE format IN ('theory', 'definition')), 0) + 1e-10, 6) AS theory_share, round(coalesce(sum(-(n / total) * ln(n / total)) FILTER (WHERE n > 0), 0) / ln(7) + 1e-10, 6) AS type_entropy FROM s GROUP BY ALL""",
    "features_statics": PANEL
    + """, nd AS (SELECT o.course_id, o.k, min(m.node_id) AS node_id FROM obs o JOIN mp0 m ON m.question_id = o.question_id AND m.k = o.k GROUP BY ALL),
    tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC) AS rn FROM tree) WHERE rn = 1),
    x AS (SELECT nd.course_id, nd.k, hours, marks_weight, concepts, count(*) OVER c AS size, count(hours) OVER c AS kh, count(marks_weight) OVER c AS km, avg(hours) OVER c AS ah, avg(marks_weight) OVER c AS am FROM nd LEFT JOIN tr USING (node_id) WINDOW c AS (PARTITION BY nd.course_id)),
    z AS (SELECT *, CASE WHEN kh * 2 >= size THEN coalesce(hours, ah) ELSE 0 END AS h, CASE WHEN km * 2 >= size THEN coalesce(marks_weight, am) ELSE 0 END AS m FROM x)
    SELECT course_id, k, round(CASE WHEN sum(h) OVER c > 0 THEN h / sum(h) OVER c * size / 10 ELSE 0 END + 1e-10, 6) AS hours_share, round(CASE WHEN sum(m) OVER c > 0 THEN m / sum(m) OVER c * size / 10 ELSE 0 END + 1e-10, 6) AS marks_weight_share,
    round(ln(1 + coalesce(len(concepts), 0)) + 1e-10, 6) AS breadth FROM z WINDOW c AS (PARTITION BY course_id)""",
    "item_similarity": PANEL
    + """, nd AS (SELECT o.course_id, o.k, min(m.node_id) AS node_id FROM obs o JOIN mp0 m ON m.question_id = o.question_id AND m.k = o.k GROUP BY ALL),
    tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC) AS rn FROM tree) WHERE rn = 1),
    w AS (SELECT DISTINCT nd.course_id, nd.k, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS w FROM nd JOIN tr USING (node_id)), n AS (SELECT course_id, k, count(*) AS n FROM w GROUP BY ALL),
    b AS (SELECT a.course_id, a.k AS k1, c.k AS k2, count(*) AS b FROM w a JOIN w c ON a.course_id = c.course_id AND a.w = c.w AND a.k <> c.k GROUP BY ALL)
    SELECT b.course_id, k1, k2, round(b / (x.n + y.n - b) + 1e-10, 6) AS sim FROM b JOIN n x ON x.course_id = b.course_id AND x.k = k1 JOIN n y ON y.course_id = b.course_id AND y.k = k2""",
    "training_rows": PANEL
    + ", h AS (SELECT course_id, k, cutoff, sum(y) AS n FROM hist GROUP BY ALL), tg AS (SELECT DISTINCT course_id, cutoff AS target FROM h) SELECT h.course_id, target, count(*) AS rows, sum(n)::BIGINT AS n_sum FROM h JOIN tg ON tg.course_id = h.course_id AND h.cutoff < target AND h.cutoff >= 2 GROUP BY ALL",
    "simple_scores": _SC + "SELECT course_id, k, cutoff, model, round(score + 1e-10, 6) AS score FROM sl",
    "percentile_rank": PANEL
    + "SELECT question_id, k, round(CASE WHEN count(*) OVER (PARTITION BY k) <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY k ORDER BY score) - 1 + (count(*) OVER (PARTITION BY k, score) - 1) / 2) / (count(*) OVER (PARTITION BY k) - 1) END + 1e-10, 6) AS pct FROM mp0",
    "fold_metrics": _FM + "SELECT course_id, model, cutoff, relevant, hit, hit_1, hit_3, hit_5, hit_10, " + _R("precision", "recall", "ndcg", "ndcg_marks", "mrr", "average_precision") + " FROM fm",
    "mean_and_se": _FM + "SELECT model, count(*) AS n, round(avg(ndcg) + 1e-10, 6) AS mean, round(stddev_samp(ndcg) / sqrt(count(*)) + 1e-10, 6) AS se FROM fm GROUP BY 1",
    "paired_tests": _FM
    + ", p AS (SELECT a.model, a.ndcg - b.ndcg AS d FROM fm a JOIN fm b ON a.course_id = b.course_id AND a.cutoff = b.cutoff AND b.model = 'frequency' WHERE a.model <> 'frequency') SELECT model, count(*) AS n, round(avg(d) + 1e-10, 6) AS mean_diff, round(stddev_samp(d) / sqrt(count(*)) + 1e-10, 6) AS se, count(*) FILTER (WHERE d > 1e-9) AS better, count(*) FILTER (WHERE d < -1e-9) AS worse FROM p GROUP BY 1",
    "running_best": _FM
    + ", c AS (SELECT DISTINCT course_id, cutoff FROM fm), p AS (SELECT c.course_id, c.cutoff, f.model, round(avg(round(f.precision, 9)), 12) AS m FROM c JOIN fm f ON f.course_id = c.course_id AND f.cutoff < c.cutoff GROUP BY ALL) SELECT course_id, cutoff, model, round(m + 1e-10, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY course_id, cutoff ORDER BY m DESC, model) = 1",
    "random_expectations": _FM
    + ", x AS (SELECT course_id, t AS cutoff, count(*) AS n, sum(y)::BIGINT AS m FROM cells GROUP BY ALL HAVING sum(y) > 0) SELECT course_id, cutoff, round(m / n + 1e-10, 6) AS precision, round(1 - list_reduce(list_prepend(1.0::DOUBLE, [greatest(n - m - i, 0)::DOUBLE / (n - i) FOR i IN range(0, least(top_k, n)::BIGINT)]), lambda a, b: a * b), 6) AS hit FROM x JOIN tk USING (course_id)",
    "reliability_bins": _FM
    + ", p AS (SELECT sl.course_id, sl.k, sl.cutoff, model, round(least(greatest(score, 0), 1), 9) AS p, rel AS y FROM sl JOIN tr USING (course_id, k, cutoff) WHERE model IN ('frequency', 'bayes')), b AS (SELECT *, ntile(10) OVER (PARTITION BY model ORDER BY p, course_id, cutoff, k) AS bin FROM p) SELECT model, bin::INT AS bin, count(*) AS n, round(avg(p) + 1e-10, 6) AS mean_p, round(avg(y) + 1e-10, 6) AS rate FROM b GROUP BY ALL",
    "brier_log_loss": _FM
    + ", p AS (SELECT model, least(greatest(score, 0), 1) AS p, rel AS y FROM sl JOIN tr USING (course_id, k, cutoff) WHERE model IN ('frequency', 'bayes')), c AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM p) SELECT model, round(avg((p - y) * (p - y)) + 1e-10, 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))) + 1e-10, 6) AS log_loss, count(*) AS n FROM c GROUP BY 1",
}
