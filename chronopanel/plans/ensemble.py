"""Queries of the whole ensemble: every model on every past exam, the final ranking, and what it rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators import backtest as K
from chronopanel.operators import features as X
from chronopanel.operators import members as B
from chronopanel.operators import metrics as M
from chronopanel.operators import models as L
from chronopanel.operators import panel as P
from chronopanel.operators import trees as T
from chronopanel.plans.forecasts import ORACLES as _FORECASTS
from chronopanel.plans.forecasts import statics
from chronopanel.plans.panels import PANEL, UNITS, cells, exams, observations, rounded, units
from chronopanel.sources.tables import cut, cut_each, drop_cut, table

BASELINES = "frequency last_exam window1 window2 window3 window5 ewma_075 ewma_15 ewma_2 ewma_3 ewma_6 linear_decay freq_recency markov semantic cooccurrence".split()
WINDOWS = ["window1", "window2", "window3", "window5"]
EWMAS = ["ewma_075", "ewma_15", "ewma_2", "ewma_3", "ewma_6"]
#: Models that choose among others by earlier exams: their variants and default.
TUNED = {
    "window": (WINDOWS, "window3"), "ewma": (EWMAS, "ewma_2"), "recency": (["frequency", "linear_decay", *WINDOWS, *EWMAS], "ewma_2"),
    "beta_binomial": (["bayes_inf", "bayes_6", "bayes_3", "bayes_15"], "bayes_6"),
}
#: Single methods that best_single chooses among.
SINGLE = ["frequency", "last_exam", "window", "ewma", "linear_decay", "freq_recency", "recency", *[m for m in B.DEGREES if m != "recency"]]


class Course:
    """The tables that all models read; each is written once."""

    def __init__(self, spark, d) -> None:
        obs = observations(spark, d)
        self.spark, self.exams = spark, P.exams_once(exams(spark, d))
        self.cells = cut(cells(spark, d, True))
        self.units, self.statics, self.formats = cut(units(spark, d)), cut(statics(spark, d)), cut(P.cell_formats(obs))
        self.post = cut(B.posteriors(self.cells, self.units))
        made: list[DataFrame] = []
        self.features = cut(B.with_posterior(X.all_features(self.cells, self.formats, self.statics, X.item_similarity(self.statics), self.units, made), self.post))
        for df in made:
            drop_cut(df)
        self.real = table(spark, d, "course").where("not is_synthetic").select("course_id").distinct()
        self.kinds = item_kinds(spark, d)
        self.last = self.exams.groupBy("course_id").agg(F.max("t").alias("last_t"))
        # Truth is known up to the last exam; the step after it is the one to forecast.
        self.past = self.cells.join(self.last, "course_id").where("t <= last_t").drop("last_t")
        self.top_k = cut(P.resolve_top_k(self.past))


def item_kinds(spark, d) -> DataFrame:
    """course_id, k, kind: the tags of an item's node and of all nodes below it."""
    nodes = T.item_nodes(P.mappings_once(table(spark, d, "mappings")), observations(spark, d))
    tree = T.latest(table(spark, d, "tree"), "node_id", "loaded_at", ["parent_id", "kinds"])
    kinds = T.kinds_below(tree).withColumnRenamed("node_id", "_n")
    return nodes.join(kinds, F.col("node_id") == F.col("_n")).select("course_id", "k", "kind")


def _tagged(df: DataFrame, model: str) -> DataFrame:
    return df.select("course_id", "k", "cutoff", F.lit(model).alias("model"), "score")


def general(c: Course):
    """The general model's prior and, for each part of the courses, its update by the real courses of the other parts."""
    prior = B.general_prior(c.spark)
    truth = c.past.select("course_id", "k", F.col("t").alias("cutoff"), "y")
    rows = c.features.select("course_id", "k", "cutoff", *B.GENERIC).join(truth, ["course_id", "k", "cutoff"]).join(c.real, "course_id", "left_semi")
    return prior, B.repository_models(rows, prior)


def member_scores(c: Course) -> DataFrame:
    """course_id, k, cutoff, model, score of all models that don't look at earlier folds; each is written by a plan of its own."""
    prior, models = general(c)
    long = X.long_scores(X.scores(c.features), BASELINES).where("model <> 'cooccurrence' or cutoff >= 2")
    draw = (F.pmod(F.xxhash64("course_id", "k", "cutoff", F.lit(13)), F.lit(1_000_003)) / 1_000_003).alias("score")
    parts = [
        long, _tagged(c.features.select("course_id", "k", "cutoff", draw), "random"), B.recurrence_scores(c.post), _tagged(B.temporal_scores(c.features, c.post, c.past), "hazard"),
        _tagged(B.coverage_scores(c.cells, c.units, c.statics), "coverage"), _tagged(B.question_type_scores(B.format_mixes(c.cells, c.formats), B.format_prior(c.kinds)), "question_type"),
        _tagged(B.general_scores(c.features, prior, models), "general"), _tagged(B.course_logistic(c.features, c.past, prior, models), "logistic"), _tagged(L.pooled_hmm(c.cells), "hmm"),
    ]
    return cut_each(parts)


class Backtest:
    """What the walk through the courses gives of all models and the ensemble, at every cutoff and the one to forecast; only
    what is wanted is made."""

    def __init__(self, spark, d, *want: str) -> None:
        c = self.course = Course(spark, d)
        first = member_scores(c)
        quality = B.input_quality(c.cells, c.formats, c.exams, c.statics)
        rows = first.unionByName(K.facts(c.past, c.features.select("course_id", "k", "cutoff", "variance_ratio"), c.top_k, c.exams, quality))
        x = cut(K.walk(rows, TUNED, SINGLE, want))
        of = lambda what, *columns: x.where(F.col("what") == what).select(*columns)
        fold = ["course_id", "cutoff", "model", F.col("a").alias("ndcg")]
        self.folds, self.without = of("fold", *fold), of("ablation", *fold)
        self.weights = of("weight", "course_id", "cutoff", F.col("model").alias("member"), F.col("a").alias("reliability"), F.col("b").alias("skill"), F.col("n").alias("folds"), F.col("c").alias("weight"))
        self.shares = of("share", "course_id", "k", "cutoff", F.col("model").alias("member"), F.col("a").alias("weight"), F.col("b").alias("rank"), F.col("c").alias("share"))
        self.made = of("score", "course_id", "k", "cutoff", "model", F.col("a").alias("score"))
        self.scores = first.unionByName(self.made)


def _flagship(spark, d):
    """Every model, the chosen single one and the ensemble on every past exam: mean and standard error of the ranking."""
    return rounded(M.mean_and_se(Backtest(spark, d, "fold").folds, "ndcg", "model"))


def _forecast(b: Backtest) -> DataFrame:
    c = b.course
    nxt = c.last.select("course_id", (F.col("last_t") + 1).cast("int").alias("cutoff"))
    e = b.made.where("model = 'ensemble'").join(nxt, ["course_id", "cutoff"])
    return e.withColumn("rank", F.row_number().over(W.partitionBy("course_id").orderBy(F.desc(F.round("score", 12)), "k"))).join(c.top_k, "course_id")


def _ranking(spark, d):
    """The forecast: items of the next exam by the ensemble, with rank, category, evidence, and the members that speak most
    for the item."""
    b = Backtest(spark, d, "score", "share")
    r = _forecast(b)
    why = b.shares.groupBy("course_id", "k", "cutoff").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "member"))).alias("w"))
    r = r.join(why, ["course_id", "k", "cutoff"]).join(b.course.features.select("course_id", "k", "cutoff", "variance_ratio"), ["course_id", "k", "cutoff"])
    cat = F.when(F.col("rank") <= F.ceil(F.col("top_k") * 0.34), "very high").when(F.col("rank") <= F.col("top_k"), "high").when(F.col("rank") <= 2 * F.col("top_k"), "medium").otherwise("low")
    because = F.array_join(F.transform(F.slice("w", 1, 3), lambda x: x["member"]), ", ")
    return rounded(r.select("course_id", "k", "cutoff", "score", "rank", cat.alias("category"), B.evidence_label(F.col("variance_ratio")).alias("evidence"), because.alias("because")))


def _uncertainty(spark, d):
    """Intervals of the ranks of the forecast, by draws from posteriors and weights and by leaving out each past exam."""
    b = Backtest(spark, d, "share")
    c = b.course
    nxt = c.last.select("course_id", (F.col("last_t") + 1).cast("int").alias("cutoff"))
    post = c.post.where("variant = '6'").join(nxt, ["course_id", "cutoff"]).select("course_id", "k", "mean", "kappa", "variance_ratio")
    shares = b.shares.join(nxt, ["course_id", "cutoff"]).select("course_id", "k", "member", "weight", "rank")
    return rounded(L.rank_intervals(shares, post, c.past))


def _status(spark, d):
    b = Backtest(spark, d, "weight")
    nxt = b.course.last.select("course_id", (F.col("last_t") + 1).cast("int").alias("cutoff"))
    return rounded(B.member_status(b.weights.join(nxt, ["course_id", "cutoff"], "left_semi")))


def _select_final(spark, d):
    """Whether the ensemble is final, or the single method chosen on earlier exams beats it beyond the t bound."""
    f = Backtest(spark, d, "fold").folds.where("model in ('ensemble', 'best_single')")
    x = M.paired(f, "ndcg", "ensemble").withColumn("beats", F.col("mean_diff") > M.t_bound(F.col("n")) * F.col("se"))
    return rounded(x.select("model", "n", "mean_diff", "se", F.coalesce("beats", F.lit(False)).cast("int").alias("beats")))


def _ablation(spark, d):
    """Mean quality of ensembles that leave one member out, against the whole one."""
    return rounded(M.paired(Backtest(spark, d, "ablation").without, "ndcg", "all"))


def _logistic(spark, d):
    c = Course(spark, d)
    return rounded(B.course_logistic(c.features, c.past, *general(c)))


def _temporal(spark, d):
    c = Course(spark, d)
    return rounded(B.temporal_scores(c.features, c.post, c.past))


def _simple(f):
    return lambda s, d: rounded(f(s, d))


QUERIES = {
    "flagship_backtest": _flagship,
    "ensemble_ranking": _ranking,
    "rank_uncertainty": _uncertainty,
    "member_status": _status,
    "select_final": _select_final,
    "ablation": _ablation,
    "course_logistic": _logistic,
    "temporal_scores": _temporal,
    "ensemble_weights": lambda s, d: rounded(Backtest(s, d, "weight").weights),
    "model_scores": lambda s, d: rounded(Backtest(s, d, "score").scores),
    "features_all": lambda s, d: rounded(Course(s, d).features),
    "recurrence_posteriors": lambda s, d: rounded(B.posteriors(cells(s, d, True), units(s, d))),
    "coverage_scores": lambda s, d: rounded(B.coverage_scores(cells(s, d, True), units(s, d), statics(s, d))),
    "question_type_scores": lambda s, d: rounded(B.question_type_scores(B.format_mixes(cells(s, d, True), P.cell_formats(observations(s, d))), B.format_prior(item_kinds(s, d)))),
    "format_prior": lambda s, d: B.format_prior(item_kinds(s, d)),
    "syllabus_share": lambda s, d: rounded(B.syllabus_share(statics(s, d))),
    "input_quality": lambda s, d: rounded(B.input_quality(cells(s, d, True), P.cell_formats(observations(s, d)), P.exams_once(exams(s, d)), statics(s, d))),
    "unit_recency": lambda s, d: rounded(X.unit_recency(cells(s, d, True), units(s, d)).where("cutoff > 0")),
}
_STATICS = _FORECASTS["features_statics"]
ORACLES = {
    "syllabus_share": f"SELECT course_id, k, round(CASE WHEN max(hours_share) OVER w > 0 THEN hours_share WHEN max(marks_weight_share) OVER w > 0 THEN marks_weight_share WHEN max(breadth) OVER w > min(breadth) OVER w THEN breadth + 0.5 ELSE 1 END, 6) AS share, CASE WHEN max(hours_share) OVER w > 0 THEN 'hours' WHEN max(marks_weight_share) OVER w > 0 THEN 'marks' WHEN max(breadth) OVER w > min(breadth) OVER w THEN 'breadth' ELSE 'uniform' END AS source FROM ({_STATICS}) WINDOW w AS (PARTITION BY course_id)",
    "unit_recency": UNITS
    + ", u AS (SELECT course_id, unit, t, max(y) AS y FROM cells JOIN un USING (course_id, k) GROUP BY ALL), g AS (SELECT DISTINCT course_id, unit, t AS cutoff FROM cellsf JOIN un USING (course_id, k) WHERE t > 0) SELECT g.course_id, g.unit, g.cutoff, round(sum(y * pow(0.5, (cutoff - 1 - t) / 1.5)) / sum(pow(0.5, (cutoff - 1 - t) / 1.5)) + 1e-10, 6) AS unit_ewma FROM g JOIN u ON u.course_id = g.course_id AND u.unit = g.unit AND u.t < g.cutoff GROUP BY ALL",
    "format_prior": UNITS
    + ", kd AS (SELECT nd1.course_id, nd1.k, unnest(t.kinds) AS kind FROM nd1 JOIN upw u ON u.at = nd1.node_id JOIN tr0 t ON t.node_id = u.node_id) SELECT course_id, k, "
    + ", ".join(f"max((kind = '{f}')::INT) AS tag_{f}" for f in P.FORMATS)
    + f" FROM kd WHERE kind IN {B.TAGGED} GROUP BY ALL",
    "input_quality": PANEL
    + """, pq AS (SELECT a.course_id, a.t AS cutoff, sum(b.n_questions) AS q, sum(b.map_conf_sum) AS mc, sum(b.parse_conf_sum) AS pc, sum(b.marks_known_sum) AS mk FROM (SELECT DISTINCT course_id, t FROM cellsf WHERE t > 0) a JOIN cells b ON a.course_id = b.course_id AND b.t < a.t GROUP BY ALL),
    ff AS (SELECT pq.course_id, pq.cutoff, count(DISTINCT o.format) AS n FROM pq LEFT JOIN obs o ON o.course_id = pq.course_id AND o.t < pq.cutoff GROUP BY ALL),
    ys AS (SELECT pq.course_id, pq.cutoff, count(DISTINCT y.year) AS n, max(y.year) - min(y.year) + 1 AS span FROM pq LEFT JOIN (SELECT course_id, t, min(year) AS year FROM ex WHERE year IS NOT NULL GROUP BY ALL) y ON y.course_id = pq.course_id AND y.t < pq.cutoff GROUP BY ALL),
    nd AS (SELECT o.course_id, o.k, min(m.node_id) AS node_id FROM obs o JOIN mp0 m ON m.question_id = o.question_id AND m.k = o.k GROUP BY ALL),
    tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC) AS rn FROM tree) WHERE rn = 1),
    st AS (SELECT nd.course_id, CASE WHEN count(hours) * 2 >= count(*) AND max(hours) > 0 THEN 1.0 WHEN count(marks_weight) * 2 >= count(*) AND max(marks_weight) > 0 THEN 1.0 WHEN max(coalesce(len(concepts), 0)) > min(coalesce(len(concepts), 0)) THEN 0.85 ELSE 0.7 END AS cv FROM nd LEFT JOIN tr USING (node_id) GROUP BY 1),
    z AS (SELECT pq.course_id, pq.cutoff, CASE WHEN q > 0 THEN mc / q ELSE 1 END AS mc, CASE WHEN q > 0 THEN pc / q ELSE 1 END AS pc, CASE WHEN q > 0 THEN mk / q ELSE 1 END AS mk, ff.n AS f, CASE WHEN ys.n >= 2 THEN 1 - 0.5 * (span - ys.n) / span ELSE 1 END AS tp, cv FROM pq JOIN ff USING (course_id, cutoff) JOIN ys USING (course_id, cutoff) LEFT JOIN st USING (course_id)),
    u AS (SELECT course_id, cutoff, unnest(['semantic', 'question_type', 'coverage', 'general', 'recency', 'beta_binomial', 'hazard', 'markov', 'hmm', 'cooccurrence', 'logistic']) AS member, unnest([(0.5 + 0.5 * mc) * 0.8, least(1.0, greatest(f, 1) / 3.0), cv, 1.0, tp, tp, tp, tp, tp, tp, 0.5 + 0.25 * mk + 0.25 * pc]::DOUBLE[]) AS quality FROM z)
    SELECT course_id, cutoff, member, round(quality + 1e-10, 6) AS quality FROM u""",
}
