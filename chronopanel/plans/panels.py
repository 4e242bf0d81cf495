"""Queries of the panel and of its dynamics, over exams, questions and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import dynamics as D
from chronopanel.operators import panel as P
from chronopanel.operators import trees as T
from chronopanel.sources.tables import table


def exams(spark, d):
    return table(spark, d, "exams")


def observations(spark, d):
    return P.observations(exams(spark, d), table(spark, d, "questions"), table(spark, d, "mappings"))


def cells(spark, d, future=False):
    return P.build_cells(exams(spark, d), observations(spark, d), future)


def units(spark, d):
    """The syllabus unit of every item."""
    nodes = T.item_nodes(P.mappings_once(table(spark, d, "mappings")), observations(spark, d))
    return T.item_units(nodes, table(spark, d, "tree"))


def rounded(df, *columns):
    """Doubles to six places, for comparison; a nudge keeps exact halves from falling either way."""
    cols = columns or [c for c, t in df.dtypes if t == "double"]
    return df.select(*[F.round(F.col(c) + F.lit(1e-10), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _with(f, future=False, **kw):
    return lambda spark, d: rounded(f(cells(spark, d, future), **kw))


def _ewma(spark, d):
    x = cells(spark, d, True).select("course_id", "k", F.col("t"), "y", D.ewma("y", 1.5).alias("ewma_short"), D.ewma("y", 6.0).alias("ewma_long"))
    return rounded(x.where("t > 0").select("course_id", "k", F.col("t").alias("cutoff"), "ewma_short", "ewma_long"))


def _linear(spark, d):
    x = D.with_position(cells(spark, d, True)).select("course_id", "k", "t", D.linear_decay().alias("linear_decay"))
    return rounded(x.where("t > 0").select("course_id", "k", F.col("t").alias("cutoff"), "linear_decay"))


def _since(spark, d):
    x = cells(spark, d, True).select("course_id", "k", F.col("t").alias("cutoff"), D.since_last().alias("since"))
    return x


def _last_n(spark, d):
    m = lambda n: F.avg("y").over(P.last(n)).alias(f"last{n}")
    x = cells(spark, d, True).select("course_id", "k", "t", m(1), m(2), m(3), m(5), F.sum("y").over(P.last(3)).alias("recent_hits"))
    return rounded(x.where("t > 0").select("course_id", "k", F.col("t").alias("cutoff"), "last1", "last2", "last3", "last5", "recent_hits"))


def _hazard_at(spark, d):
    return rounded(D.hazard_at(cells(spark, d)))


def _until(spark, d):
    """History before each cutoff: appearances and exams so far."""
    x = cells(spark, d, True).select("course_id", "k", "t", F.sum("y").over(P.before()).alias("n"), F.count("*").over(P.before()).alias("steps"))
    return x.where("t > 0").select("course_id", "k", F.col("t").alias("cutoff"), "n", "steps")


def _edges(spark, d):
    """The 60 strongest pairs of items of each course."""
    x = D.same_exam_lift(cells(spark, d)).where("together >= 3 and lift >= 1.3")
    lift = F.round(F.col("lift") + 1e-10, 6)
    r = F.row_number().over(P.W.partitionBy("course_id").orderBy(F.desc("together"), F.desc(lift), "j", "k"))
    return rounded(x.withColumn("r", r).where("r <= 60").drop("r"))


def _rollup(spark, d):
    obs = observations(spark, d).join(units(spark, d), ["course_id", "k"])
    r = obs.groupBy("course_id", "unit", "k", "question_id").agg(F.sum("share").alias("m"), F.count("*").alias("n"))
    r = r.rollup("course_id", "unit", "k").agg(F.sum("n").alias("n_obs"), F.sum("m").alias("marks"))
    return rounded(r)


QUERIES = {
    "panel_exams": lambda s, d: P.exams_once(exams(s, d)).select("course_id", (F.dense_rank().over(P.W.partitionBy("course_id").orderBy("ord", "exam_id")) - 1).cast("int").alias("step"), "exam_id", "t"),
    "panel_observations": lambda s, d: rounded(observations(s, d).select("course_id", "t", "k", "question_id", "mass", "share", "format", "optional")),
    "panel_build": _with(lambda c: c),
    "cell_formats": lambda s, d: P.cell_formats(observations(s, d)),
    "panel_until": _until,
    "drop_exam": lambda s, d: P.drop_exam(cells(s, d)).groupBy("course_id", "dropped", "k").agg(F.sum("y").alias("n"), F.max("t").alias("last_t")),
    "resolve_top_k": lambda s, d: P.resolve_top_k(cells(s, d)),
    "known_top_k": lambda s, d: P.known_top_k(cells(s, d, True)).where("cutoff > 0"),
    "evaluable_targets": lambda s, d: P.exams_once(exams(s, d)).groupBy("course_id").agg(F.max("t").alias("m")).where("m >= 1").select("course_id", F.explode(F.sequence(F.lit(1), "m")).alias("target")),
    "ewma_decay": _ewma,
    "linear_decay": _linear,
    "gap_stats": _with(D.gap_stats),
    "gap_list": _with(D.gaps),
    "pooled_hazard": _with(D.pooled_hazard),
    "hazard_at": _hazard_at,
    "transition_counts": _with(D.transition_counts),
    "trend_slope": _with(D.trend_slope),
    "sequential_lift": _with(D.sequential_lift),
    "same_exam_lift": _with(D.same_exam_lift),
    "lift_edges": _edges,
    "rotation_tests": _with(D.rotation_tests),
    "since_last": _since,
    "streaks": _with(D.streaks, True),
    "last_n_windows": _last_n,
    "rollup_totals": _rollup,
}

PANEL = """
WITH ex AS (SELECT DISTINCT course_id, t, exam_id, ord, label, total_marks, year, calendar, source_kind FROM exams WHERE course_id IS NOT NULL AND t IS NOT NULL AND exam_id IS NOT NULL),
qs AS (SELECT DISTINCT question_id, exam_id, marks, format, parse_confidence, is_optional, exact_repeat, para_repeat FROM questions WHERE question_id IS NOT NULL),
mp0 AS (SELECT DISTINCT question_id, k, node_id, rank, weight, score, status, method FROM mappings WHERE question_id IS NOT NULL AND k IS NOT NULL),
mp AS (SELECT *, weight / sum(weight) OVER (PARTITION BY question_id) AS mass FROM mp0),
obs AS (SELECT ex.course_id, ex.t, mp.k, mp.question_id, mp.rank, mp.mass, qs.marks * mp.mass AS share, (qs.marks IS NOT NULL)::BIGINT AS marks_known, mp.score, mp.status,
  CASE WHEN qs.format IN ('definition','theory','derivation','numerical','diagram','objective','mixed') THEN qs.format ELSE 'theory' END AS format,
  qs.parse_confidence, coalesce(qs.is_optional, false)::BIGINT AS optional, coalesce(qs.exact_repeat, false)::BIGINT AS exact, coalesce(qs.para_repeat, false)::BIGINT AS para
  FROM mp JOIN qs USING (question_id) JOIN ex USING (exam_id)),
agg AS (SELECT course_id, t, k, 1::BIGINT AS y, sum(share) AS marks, max(score) AS soft, count(*) AS n_questions, sum(exact)::BIGINT AS exact_repeat, sum(para)::BIGINT AS para_repeat,
  1 - exp(sum(ln(1 - least(greatest(coalesce(score * mass, 0), 0), 0.999::DOUBLE)))) AS semantic, sum(score) AS map_conf_sum, sum(parse_confidence) AS parse_conf_sum,
  sum(marks_known)::BIGINT AS marks_known_sum, sum(optional)::BIGINT AS optional_sum FROM obs GROUP BY ALL),
items AS (SELECT DISTINCT course_id, k FROM agg),
steps AS (SELECT course_id, t FROM ex UNION ALL SELECT course_id, (max(t) + 1)::INT FROM ex GROUP BY 1),
cellsf AS (SELECT s.course_id, s.t, i.k, coalesce(y, 0) AS y, coalesce(marks, 0) AS marks, coalesce(soft, 0) AS soft, coalesce(n_questions, 0) AS n_questions, coalesce(exact_repeat, 0) AS exact_repeat,
  coalesce(para_repeat, 0) AS para_repeat, coalesce(semantic, 0) AS semantic, coalesce(map_conf_sum, 0) AS map_conf_sum, coalesce(parse_conf_sum, 0) AS parse_conf_sum,
  coalesce(marks_known_sum, 0) AS marks_known_sum, coalesce(optional_sum, 0) AS optional_sum
  FROM steps s JOIN items i USING (course_id) LEFT JOIN agg a ON a.course_id = s.course_id AND a.t = s.t AND a.k = i.k),
ends AS (SELECT course_id, max(t) AS last_t FROM ex GROUP BY 1),
cells AS (SELECT c.* FROM cellsf c JOIN ends e USING (course_id) WHERE c.t <= e.last_t),
hist AS (SELECT a.course_id, a.k, a.t AS cutoff, b.t, b.y, b.marks, b.soft, b.semantic, b.n_questions FROM cellsf a JOIN cells b ON a.course_id = b.course_id AND a.k = b.k AND b.t < a.t)
"""
#: PANEL with un (course_id, k, unit): the root above the least node of an item, walked up parent by parent.
UNITS = PANEL.replace("WITH ex", "WITH RECURSIVE ex") + """, nd1 AS (SELECT o.course_id, o.k, min(m.node_id) AS node_id FROM obs o JOIN mp0 m ON m.question_id = o.question_id AND m.k = o.k GROUP BY ALL),
tr0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC) AS rn FROM tree WHERE node_id IS NOT NULL) WHERE rn = 1),
upw AS (SELECT node_id, node_id AS at, parent_id AS nxt, 1 AS n FROM tr0 UNION ALL SELECT u.node_id, l.node_id, l.parent_id, u.n + 1 FROM upw u JOIN tr0 l ON u.nxt = l.node_id WHERE u.n < 200),
rt AS (SELECT u.node_id, u.at AS root FROM upw u LEFT JOIN tr0 p ON u.nxt = p.node_id WHERE p.node_id IS NULL),
un AS (SELECT nd1.course_id, nd1.k, coalesce(rt.root, nd1.node_id) AS unit FROM nd1 LEFT JOIN rt USING (node_id))
"""
_CELL = "course_id, t, k, y, round(marks + 1e-10, 6) AS marks, round(soft + 1e-10, 6) AS soft, n_questions, exact_repeat, para_repeat, round(semantic + 1e-10, 6) AS semantic, round(map_conf_sum + 1e-10, 6) AS map_conf_sum, round(parse_conf_sum + 1e-10, 6) AS parse_conf_sum, marks_known_sum, optional_sum"
_GAPS = ", seen AS (SELECT course_id, k, t, t - lag(t) OVER (PARTITION BY course_id, k ORDER BY t) AS gap FROM cells WHERE y > 0) "
_HAZ = """, gapped AS (SELECT a.course_id, a.k, a.t, a.y, (SELECT max(b.t) FROM cells b WHERE b.course_id = a.course_id AND b.k = a.k AND b.t < a.t AND b.y > 0) AS seen FROM cells a),
base AS (SELECT course_id, avg(y) AS base FROM cells GROUP BY 1),
haz AS (SELECT course_id, coalesce(least(t - seen, 6), 0)::BIGINT AS gap, sum(y)::BIGINT AS hits, count(*) AS opportunities FROM gapped WHERE t > 0 GROUP BY 1, 2),
rates AS (SELECT h.*, (hits + 3 * base) / (opportunities + 3) AS rate FROM haz h JOIN base USING (course_id)) """
ORACLES = {
    "panel_exams": "SELECT course_id, (dense_rank() OVER (PARTITION BY course_id ORDER BY ord, exam_id) - 1)::INT AS step, exam_id, t FROM (SELECT DISTINCT course_id, t, exam_id, ord FROM exams)",
    "panel_observations": PANEL + "SELECT course_id, t, k, question_id, round(mass + 1e-10, 6) AS mass, round(share + 1e-10, 6) AS share, format, optional FROM obs",
    "panel_build": PANEL + f"SELECT {_CELL} FROM cells",
    "cell_formats": PANEL
    + "SELECT course_id, t, k, "
    + ", ".join(f"count(*) FILTER (WHERE format = '{f}') AS {f}" for f in P.FORMATS)
    + " FROM obs GROUP BY ALL",
    "panel_until": PANEL + "SELECT course_id, k, cutoff, sum(y)::BIGINT AS n, count(*) AS steps FROM hist GROUP BY ALL",
    "drop_exam": PANEL
    + "SELECT c.course_id, j.t AS dropped, c.k, sum(c.y)::BIGINT AS n, max(CASE WHEN c.t > j.t THEN c.t - 1 ELSE c.t END)::INT AS last_t FROM cells c JOIN (SELECT DISTINCT course_id, t FROM cells) j ON j.course_id = c.course_id AND j.t <> c.t GROUP BY ALL",
    "resolve_top_k": PANEL
    + ", per AS (SELECT course_id, t, sum(y) AS n FROM cells GROUP BY ALL HAVING sum(y) > 0) SELECT course_id, least(greatest(least(round_even(median(n), 0), 15), 3), any_value(size))::BIGINT AS top_k FROM per JOIN (SELECT course_id, count(*) AS size FROM items GROUP BY 1) USING (course_id) GROUP BY course_id",
    "known_top_k": PANEL
    + ", per AS (SELECT course_id, t, sum(y) AS n FROM cells GROUP BY ALL), sz AS (SELECT course_id, count(*) AS size FROM items GROUP BY 1), cs AS (SELECT DISTINCT course_id, t AS cutoff FROM cellsf WHERE t > 0) SELECT c.course_id, c.cutoff, least(greatest(least(coalesce(round_even(median(p.n) FILTER (WHERE p.n > 0), 0), 3), 15), 3), any_value(sz.size))::BIGINT AS top_k FROM cs c JOIN sz USING (course_id) JOIN per p ON p.course_id = c.course_id AND p.t < c.cutoff GROUP BY 1, 2",
    "evaluable_targets": "SELECT course_id, unnest(generate_series(1, max(t)))::INT AS target FROM exams GROUP BY course_id HAVING max(t) >= 1",
    "ewma_decay": PANEL
    + "SELECT course_id, k, cutoff, round(sum(y * pow(0.5, (cutoff - 1 - t) / 1.5)) / sum(pow(0.5, (cutoff - 1 - t) / 1.5)) + 1e-10, 6) AS ewma_short, round(sum(y * pow(0.5, (cutoff - 1 - t) / 6.0)) / sum(pow(0.5, (cutoff - 1 - t) / 6.0)) + 1e-10, 6) AS ewma_long FROM hist GROUP BY ALL",
    "linear_decay": PANEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY course_id, k, cutoff ORDER BY t) AS n FROM hist) SELECT course_id, k, cutoff, round(sum(y * n) / sum(n) + 1e-10, 6) AS linear_decay FROM r GROUP BY ALL",
    "gap_stats": PANEL + _GAPS + "SELECT course_id, k, round(avg(gap) + 1e-10, 6) AS mean_gap, round(stddev_samp(gap) + 1e-10, 6) AS sd_gap, count(*) AS n_gaps FROM seen WHERE gap IS NOT NULL GROUP BY ALL",
    "gap_list": PANEL + _GAPS + "SELECT course_id, k, t, gap::BIGINT AS gap FROM seen WHERE gap IS NOT NULL",
    "pooled_hazard": PANEL + _HAZ + "SELECT course_id, gap, hits, opportunities, round(rate + 1e-10, 6) AS rate FROM rates",
    "hazard_at": PANEL
    + _HAZ
    + ", l AS (SELECT course_id, k, coalesce(least(max(t) + 1 - max(CASE WHEN y > 0 THEN t END), 6), 0)::BIGINT AS gap FROM cells GROUP BY 1, 2) SELECT l.course_id, l.k, round(coalesce(r.rate, b.base) + 1e-10, 6) AS hazard FROM l JOIN base b USING (course_id) LEFT JOIN rates r ON r.course_id = l.course_id AND r.gap = l.gap",
    "transition_counts": PANEL
    + ", p AS (SELECT *, lag(y) OVER (PARTITION BY course_id, k ORDER BY t) AS p FROM cells) SELECT course_id, k, "
    + ", ".join(f"count(*) FILTER (WHERE p = {a} AND y = {b}) AS n{a}{b}" for a in (0, 1) for b in (0, 1))
    + " FROM p WHERE p IS NOT NULL GROUP BY ALL",
    "trend_slope": PANEL
    + "SELECT c.course_id, c.k, round(CASE WHEN count(*) >= 3 THEN regr_slope(c.y, c.t) ELSE 0 END + 1e-10, 6) AS slope FROM cells c JOIN ends e USING (course_id) WHERE c.t > e.last_t - 6 GROUP BY 1, 2",
    "sequential_lift": PANEL
    + ", b AS (SELECT course_id, k, avg(y) AS base FROM cells GROUP BY ALL), n AS (SELECT c.course_id, c.k AS j, count(*) AS n_j FROM cells c JOIN ends e USING (course_id) WHERE c.y > 0 AND c.t < e.last_t GROUP BY ALL), p AS (SELECT a.course_id, a.k AS j, c.k, count(*) AS together FROM cells a JOIN cells c ON a.course_id = c.course_id AND c.t = a.t + 1 WHERE a.y > 0 AND c.y > 0 GROUP BY ALL) SELECT p.course_id, p.j, p.k, together, round(((together + 2 * base) / (n_j + 2)) / (base + 1e-6) + 1e-10, 6) AS lift FROM p JOIN n ON n.course_id = p.course_id AND n.j = p.j JOIN b ON b.course_id = p.course_id AND b.k = p.k",
    "streaks": PANEL
    + ", h AS (SELECT course_id, k, cutoff, max(CASE WHEN y > 0 THEN t END) AS one, max(CASE WHEN y = 0 THEN t END) AS nil FROM hist GROUP BY ALL) SELECT f.course_id, f.k, f.t AS cutoff, (CASE WHEN coalesce(one, -1) > coalesce(nil, -1) THEN f.t - 1 - coalesce(nil, -1) ELSE 0 END)::BIGINT AS present, (CASE WHEN coalesce(nil, -1) > coalesce(one, -1) THEN f.t - 1 - coalesce(one, -1) ELSE 0 END)::BIGINT AS absent FROM cellsf f LEFT JOIN h ON h.course_id = f.course_id AND h.k = f.k AND h.cutoff = f.t",
    "since_last": PANEL
    + ", h AS (SELECT course_id, k, cutoff, max(CASE WHEN y > 0 THEN t END) AS one FROM hist GROUP BY ALL) SELECT f.course_id, f.k, f.t AS cutoff, coalesce(f.t - one, f.t + 1)::BIGINT AS since FROM cellsf f LEFT JOIN h ON h.course_id = f.course_id AND h.k = f.k AND h.cutoff = f.t",
    "last_n_windows": PANEL
    + "SELECT course_id, k, cutoff, "
    + ", ".join(f"round(avg(y) FILTER (WHERE t >= cutoff - {n}) + 1e-10, 6) AS last{n}" for n in (1, 2, 3, 5))
    + ", sum(y) FILTER (WHERE t >= cutoff - 3)::BIGINT AS recent_hits FROM hist GROUP BY ALL",
    "rollup_totals": UNITS + "SELECT course_id, unit, k, count(*) AS n_obs, round(sum(share) + 1e-10, 6) AS marks FROM obs JOIN un USING (course_id, k) GROUP BY ROLLUP (course_id, unit, k)",
}
_PAIRS = ", b AS (SELECT course_id, k, avg(y) AS base FROM cells GROUP BY ALL), n AS (SELECT course_id, k AS j, count(*) AS n_j FROM cells WHERE y > 0 GROUP BY ALL), p AS (SELECT a.course_id, a.k AS j, c.k, count(*) AS together FROM cells a JOIN cells c ON a.course_id = c.course_id AND c.t = a.t AND a.k < c.k WHERE a.y > 0 AND c.y > 0 GROUP BY ALL), lifts AS (SELECT p.course_id, p.j, p.k, together, round(((together + 2 * base) / (n_j + 2)) / (base + 1e-6) + 1e-10, 6) AS lift FROM p JOIN n ON n.course_id = p.course_id AND n.j = p.j JOIN b ON b.course_id = p.course_id AND b.k = p.k) "
ORACLES["same_exam_lift"] = PANEL + _PAIRS + "SELECT * FROM lifts"
ORACLES["lift_edges"] = PANEL + _PAIRS + "SELECT * FROM lifts WHERE together >= 3 AND lift >= 1.3 QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY together DESC, lift DESC, j, k) <= 60"
