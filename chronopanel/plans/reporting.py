"""Queries of trees, reports, reviews, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import hierarchy as H
from chronopanel.operators import panel as P
from chronopanel.operators import reports as R
from chronopanel.operators import review as V
from chronopanel.operators import trees as T
from chronopanel.plans.forecasts import _SC, simple_scores
from chronopanel.plans.hierarchies import _CHAIN
from chronopanel.plans.panels import PANEL, UNITS, cells, exams, observations, rounded, units
from chronopanel.sources.tables import cut, table


def facts(spark, d):
    return H.latest(table(spark, d, "tree"), "node_id", "loaded_at", ["parent_id", "depth", "title", "concepts", "kinds", "hours", "excluded", "course_id"])


def _nested(spark, d):
    return cut(H.hierarchy(table(spark, d, "tree")))


def questions(spark, d, *columns):
    return P.questions_once(table(spark, d, "questions"), *columns)


def maps(spark, d):
    return P.mappings_once(table(spark, d, "mappings"))


def _edits(spark, d):
    """Corrections as they might come in: every question that needs review gets new marks, twice; those without marks are
    taken out."""
    q = questions(spark, d, "marks", "needs_review").where("needs_review")
    two = q.select("question_id", "marks", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return two.select("question_id", "seq", F.col("seq").cast("double").alias("marks"), F.col("marks").isNull().alias("deleted"))


def _changed(spark, d):
    """What a second, stricter reading changes: questions read with little confidence are dropped."""
    q = questions(spark, d, "exam_id", "marks", "format", "parse_confidence")
    f = lambda x: V.fingerprint(x, F.col("exam_id"), "question_id", "marks", "format")
    return V.changed_parts(f(q), f(q.where("parse_confidence >= 0.6")))


def _search_filters(spark, d):
    """Leaf questions of dated exams with a type, whose main node is mapped: semi joins and array filters."""
    q = P.questions_once(table(spark, d, "questions"), "exam_id", "types", "is_leaf").where(F.col("is_leaf") & F.array_contains("types", "numerical"))
    e = P.exams_once(exams(spark, d)).where("year is not null").select("exam_id")
    m = maps(spark, d).where("rank = 1").select("question_id")
    return q.join(e, "exam_id", "left_semi").join(m, "question_id", "left_semi").select("question_id", "exam_id")


def _full_outer(spark, d):
    """Keyword scores and semantic scores of questions brought together: the greater one counts."""
    kw = questions(spark, d, "text").where(F.lower("text").contains("voltage")).select("question_id", (1.0 / F.length("text")).alias("kw"))
    sem = maps(spark, d).groupBy("question_id").agg(F.max("score").alias("sem")).where("sem > 0.5")
    return rounded(kw.join(sem, "question_id", "full_outer").select("question_id", F.greatest("kw", "sem").alias("score")))


def _dedupe(spark, d):
    f = table(spark, d, "source_file").where("course_id is not null and sha256 is not null")
    return f.groupBy("course_id", "sha256").agg(F.min("file_id").alias("file_id"), F.count_distinct("file_id").alias("uploads"))


def _strictly_before(spark, d):
    """For each mapped question, how many earlier exams of its course held the item: a window, not a range join."""
    o = observations(spark, d).select("course_id", "t", "k", "question_id")
    per = o.select("course_id", "k", "t").distinct().withColumn("before", F.row_number().over(P.W.partitionBy("course_id", "k").orderBy("t")) - 1)
    return o.join(per, ["course_id", "k", "t"]).groupBy("course_id", "k").agg(F.sum("before").alias("before"), F.count("*").alias("n"))


def _reconcile(spark, d):
    """Items whose counts in the history differ from those in the panel: there must be none."""
    a = R.node_stats(observations(spark, d)).select("course_id", "k", F.col("exams").alias("a"))
    b = cells(spark, d).groupBy("course_id", "k").agg(F.sum("y").alias("b"))
    return a.join(b, ["course_id", "k"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("course_id", "k", "a", "b")


def _summary(spark, d):
    c = table(spark, d, "course").select("course_id", "name").distinct()
    e = P.exams_once(exams(spark, d)).groupBy("course_id").agg(F.count("*").alias("exams"))
    f = table(spark, d, "source_file").groupBy("course_id").agg(F.count_distinct("file_id").alias("files"))
    n = facts(spark, d).groupBy("course_id").agg(F.count("*").alias("nodes"))
    for x in (e, f, n):
        c = c.join(x, "course_id", "left")
    return c.na.fill(0, ["exams", "files", "nodes"])


def _moves(spark, d):
    """Every node moved below its own first child: always a cycle where there is one."""
    f = facts(spark, d)
    moves = f.where("parent_id is not null and parent_id <> node_id").groupBy(F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("new_parent_id"))
    return T.rejected_moves(_nested(spark, d), moves.join(f.select("node_id"), "node_id", "left_semi"))


QUERIES = {
    "tree_roles": lambda s, d: T.roles(_nested(s, d), facts(s, d)),
    "tree_preorder": lambda s, d: _nested(s, d).where("lft is not null").select("node_id", "root_id", "depth", "n_descendants"),
    "node_documents": lambda s, d: T.node_documents(facts(s, d)),
    "kind_prior": lambda s, d: T.kind_prior(_nested(s, d), facts(s, d)),
    "rejected_moves": _moves,
    "context_texts": lambda s, d: T.context_texts(questions(s, d, "text", "parent_id")),
    "node_stats": lambda s, d: rounded(R.node_stats(observations(s, d))),
    "unit_coverage": lambda s, d: rounded(R.unit_coverage(observations(s, d), units(s, d))),
    "topic_coverage": lambda s, d: rounded(R.topic_coverage(cells(s, d))),
    "cooccurrence_tests": lambda s, d: rounded(R.cooccurrence(cells(s, d))),
    "exam_structure": lambda s, d: rounded(R.exam_structure(questions(s, d, "exam_id", "or_group", "parent_id", "marks", "is_optional"))),
    "main_marks": lambda s, d: rounded(R.main_marks(questions(s, d, "exam_id", "or_group", "parent_id", "marks"))),
    "usual_structure": lambda s, d: rounded(R.usual_structure(R.exam_structure(questions(s, d, "exam_id", "or_group", "parent_id", "marks", "is_optional")), P.exams_once(exams(s, d)))),
    "format_forecast": lambda s, d: rounded(R.format_forecast(observations(s, d))),
    "missing_years": lambda s, d: R.missing_years(P.exams_once(exams(s, d))),
    "timeline": lambda s, d: R.timeline(P.exams_once(exams(s, d))),
    "evidence_profile": lambda s, d: rounded(R.evidence_profile(cells(s, d), P.exams_once(exams(s, d)), observations(s, d))),
    "evidence_lines": lambda s, d: R.evidence_lines(R.node_stats(observations(s, d))),
    "marks_histogram": lambda s, d: R.histogram(questions(s, d, "exam_id", "marks"), "marks", "exam_id"),
    "marks_percentiles": lambda s, d: rounded(questions(s, d, "format", "marks").where("marks is not null and format is not null").groupBy("format").agg(F.percentile("marks", F.lit(0.25)).alias("p25"), F.median("marks").alias("p50"), F.percentile("marks", F.lit(0.75)).alias("p75"))),
    "capped_choice": lambda s, d: rounded(R.capped_choice(simple_scores(s, d).where("model = 'bayes'").join(P.exams_once(exams(s, d)).groupBy("course_id").agg((F.max("t") + 1).alias("cutoff")), ["course_id", "cutoff"]).select("course_id", "k", "score"), units(s, d))),
    "mapping_status": lambda s, d: rounded(maps(s, d).select("question_id", "k", V.mapping_status(F.col("score")).alias("by_score"), V.match_confidence(F.col("score")).alias("confidence"), V.counts_for_prediction(F.col("status"), F.col("method"), F.col("score")).cast("int").alias("counted"))),
    "review_overlay": lambda s, d: rounded(V.overlay(questions(s, d, "exam_id", "marks"), _edits(s, d), "question_id", ["marks"])),
    "merge_with_next": lambda s, d: rounded(V.merged_with_next(questions(s, d, "exam_id", "text", "marks"))),
    "split_questions": lambda s, d: V.split_at_sentences(questions(s, d, "text")),
    "changed_parts": _changed,
    "search_filters": _search_filters,
    "hybrid_full_outer": _full_outer,
    "file_dedupe": _dedupe,
    "strictly_before": _strictly_before,
    "history_reconcile": _reconcile,
    "course_summary": _summary,
}

_LAT = "lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC) AS rn FROM tree WHERE node_id IS NOT NULL) WHERE rn = 1)"
_Q = "WITH q AS (SELECT DISTINCT question_id, exam_id, text, marks, format, or_group, parent_id, is_optional, is_leaf FROM questions WHERE question_id IS NOT NULL), e AS (SELECT DISTINCT course_id, t, exam_id, ord, label, total_marks, year, calendar, source_kind FROM exams), m AS (SELECT DISTINCT question_id, k, node_id, rank, weight, score, status, method FROM mappings) "
_TOP = ", p AS (SELECT parent_id AS question_id, count(*) AS parts FROM q WHERE parent_id IS NOT NULL GROUP BY 1), st AS (SELECT exam_id, count(*) AS questions, count(DISTINCT coalesce(or_group, 'q' || question_id)) AS slots, median(coalesce(parts, 0)) AS parts_median, median(marks) AS marks_median, count(*) FILTER (WHERE is_optional) AS optional FROM (SELECT * FROM q WHERE parent_id IS NULL) LEFT JOIN p USING (question_id) GROUP BY 1) "
_MISS = ", yy AS (SELECT DISTINCT course_id, calendar, year FROM e WHERE year IS NOT NULL AND calendar IS NOT NULL), miss AS (SELECT s.course_id, s.calendar, s.year FROM (SELECT course_id, calendar, unnest(generate_series(min(year), max(year)))::INT AS year FROM yy GROUP BY course_id, calendar) s ANTI JOIN yy USING (course_id, calendar, year)) "
_CONF = "CASE WHEN score IS NULL THEN NULL WHEN score <= 0.12::DOUBLE THEN greatest(0, score / 0.12::DOUBLE * 0.25) WHEN score <= 0.22::DOUBLE THEN 0.25 + (score - 0.12::DOUBLE) / 0.1::DOUBLE * 0.25 WHEN score <= 0.34::DOUBLE THEN 0.5 + (score - 0.22::DOUBLE) / 0.12::DOUBLE * 0.25 ELSE least(0.75 + 0.25 * (score - 0.34::DOUBLE) / 0.3::DOUBLE, 1) END"
ORACLES = {
    "tree_roles": _CHAIN.replace("depth, title FROM", "depth, title, excluded FROM")
    + """, kids AS (SELECT DISTINCT parent_id AS node_id FROM latest WHERE parent_id IS NOT NULL),
    l2 AS (SELECT u.node_id, u.at AS topic FROM up u JOIN ends a ON a.node_id = u.at AND a.depth = 2 WHERE u.n > 1), ex AS (SELECT u.node_id, max(coalesce(l.excluded, false)::INT) AS excluded FROM up u JOIN latest l ON l.node_id = u.at GROUP BY 1)
    SELECT e.node_id, e.depth::INT AS depth, CASE WHEN e.depth = 2 OR (e.depth = 1 AND k.node_id IS NULL) THEN 'topic' WHEN e.depth = 1 THEN 'unit' WHEN k.node_id IS NULL THEN 'concept' ELSE 'group' END AS role, e.root AS unit_id,
    CASE WHEN e.depth = 2 OR (e.depth = 1 AND k.node_id IS NULL) THEN e.node_id ELSE l2.topic END AS topic_id, (k.node_id IS NULL)::INT AS is_leaf, ex.excluded FROM ends e LEFT JOIN kids k USING (node_id) LEFT JOIN l2 USING (node_id) JOIN ex USING (node_id)""",
    "tree_preorder": _CHAIN + ", d AS (SELECT u.at AS node_id, count(*) - 1 AS n FROM up u JOIN ends e USING (node_id) GROUP BY 1) SELECT e.node_id, e.root AS root_id, e.depth::INT AS depth, d.n AS n_descendants FROM ends e JOIN d USING (node_id)",
    "node_documents": f"WITH {_LAT} SELECT a.node_id, concat_ws(' ', a.title, a.title, coalesce(array_to_string(a.concepts, ' '), ''), p.title) AS document FROM lat a LEFT JOIN lat p ON a.parent_id = p.node_id",
    "kind_prior": _CHAIN.replace("depth, title FROM", "depth, title, kinds FROM") + "SELECT DISTINCT node_id, kind FROM (SELECT node_id, unnest(kinds) AS kind FROM latest UNION ALL SELECT u.at AS node_id, unnest(l.kinds) AS kind FROM up u JOIN ends USING (node_id) JOIN latest l ON l.node_id = u.node_id WHERE u.n > 1)",
    "rejected_moves": _CHAIN + "SELECT l.parent_id AS node_id, min(l.node_id) AS new_parent_id, 'cycle' AS reason FROM latest l JOIN ends e ON e.node_id = l.parent_id WHERE l.parent_id <> l.node_id GROUP BY 1",
    "context_texts": "WITH RECURSIVE q AS (SELECT DISTINCT question_id, text, parent_id, nullif(array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:60], ' '), '') AS stem FROM questions WHERE question_id IS NOT NULL), c AS (SELECT question_id, parent_id, text, NULL::VARCHAR AS above, 0 AS n FROM q UNION ALL SELECT c.question_id, p.parent_id, c.text, nullif(concat_ws(' ', p.stem, c.above), ''), n + 1 FROM c JOIN q p ON c.parent_id = p.question_id WHERE n < 200) SELECT question_id, concat_ws(' ', above, trim(text)) AS context FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC) = 1",
    "node_stats": PANEL
    + """, pe AS (SELECT course_id, k, t, max((rank = 1)::INT) AS main FROM obs GROUP BY ALL), mi AS (SELECT course_id, k, count(*) FILTER (WHERE main = 0) AS minor_exams FROM pe GROUP BY ALL)
    SELECT course_id, k, count(DISTINCT t) AS exams, count(*) AS questions, count(*) FILTER (WHERE rank = 1) AS main_questions, count(*) FILTER (WHERE rank <> 1) AS minor_questions, min(t) AS first_t, max(t) AS last_t, round(min(share) + 1e-10, 6) AS marks_min,
    round(max(share) + 1e-10, 6) AS marks_max, round(median(share) + 1e-10, 6) AS marks_median, count(DISTINCT format) AS formats, sum(exact)::BIGINT AS exact_repeats, sum(para)::BIGINT AS para_repeats, any_value(minor_exams) AS minor_exams FROM obs JOIN mi USING (course_id, k) GROUP BY ALL""",
    "unit_coverage": UNITS
    + ", nu AS (SELECT course_id, count(DISTINCT unit) AS n FROM un GROUP BY 1), u AS (SELECT course_id, t, unit, sum(share) AS marks FROM obs JOIN un USING (course_id, k) GROUP BY ALL HAVING sum(share) > 0), s AS (SELECT *, marks / sum(marks) OVER (PARTITION BY course_id, t) AS share FROM u) SELECT course_id, t, unit, round(marks + 1e-10, 6) AS marks, round(share + 1e-10, 6) AS share, round(CASE WHEN n > 1 THEN sum(-share * ln(share)) OVER w / ln(n) ELSE 1 END + 1e-10, 6) AS balance FROM s JOIN nu USING (course_id) WINDOW w AS (PARTITION BY course_id, t)",
    "topic_coverage": PANEL + "SELECT course_id, k, round(avg(y) + 1e-10, 6) AS rate, CASE WHEN avg(y) = 0 THEN 'never' WHEN avg(y) <= 0.15 THEN 'rarely' WHEN avg(y) >= 0.9 THEN 'always' ELSE 'sometimes' END AS tested FROM cells GROUP BY ALL",
    "exam_structure": _Q + _TOP + "SELECT exam_id, questions, slots, round(parts_median + 1e-10, 6) AS parts_median, round(marks_median + 1e-10, 6) AS marks_median, optional FROM st",
    "main_marks": _Q + ", f AS (SELECT *, row_number() OVER (PARTITION BY exam_id, coalesce(or_group, 'q' || question_id) ORDER BY question_id) AS r FROM q WHERE parent_id IS NULL) SELECT exam_id, round(sum(marks) + 1e-10, 6) AS marks FROM f WHERE r = 1 GROUP BY 1",
    "usual_structure": _Q
    + _TOP
    + ", r AS (SELECT e.course_id, e.t, st.slots, row_number() OVER (PARTITION BY e.course_id ORDER BY e.t DESC) AS r FROM st JOIN e USING (exam_id)), c AS (SELECT course_id, slots, count(*) AS c, min(t) AS f FROM r WHERE r <= 5 GROUP BY ALL), b AS (SELECT *, sum(c) OVER (PARTITION BY course_id) AS n, row_number() OVER (PARTITION BY course_id ORDER BY c DESC, f) AS b FROM c) SELECT course_id, slots, round(c / n + 1e-10, 6) AS share, CASE WHEN c / n >= 0.8 AND n >= 3 THEN 'high' WHEN c / n >= 0.6 THEN 'usual' ELSE 'variable' END AS certainty FROM b WHERE b = 1",
    "format_forecast": PANEL
    + """, w AS (SELECT obs.*, pow(0.5, (last_t - t) / 3.0) AS w FROM obs JOIN ends USING (course_id)), fs AS (SELECT unnest(['definition','theory','derivation','numerical','diagram','objective','mixed']) AS format),
    g0 AS (SELECT c.course_id, fs.format, coalesce(sum(w.w), 0) + 0.5 AS g FROM (SELECT DISTINCT course_id FROM obs) c CROSS JOIN fs LEFT JOIN w ON w.course_id = c.course_id AND w.format = fs.format GROUP BY ALL), g AS (SELECT course_id, format, g / sum(g) OVER (PARTITION BY course_id) AS g FROM g0),
    i AS (SELECT it.course_id, it.k, g.format, g.g, coalesce(sum(w.w), 0) AS i FROM items it JOIN g USING (course_id) LEFT JOIN w ON w.course_id = it.course_id AND w.k = it.k AND w.format = g.format GROUP BY ALL)
    SELECT course_id, k, format, round((i + 2 * g) / (sum(i) OVER (PARTITION BY course_id, k) + 2) + 1e-10, 6) AS p FROM i""",
    "missing_years": _Q + _MISS + "SELECT * FROM miss",
    "timeline": _Q + _MISS + "SELECT course_id, calendar, year, CASE WHEN year IS NULL THEN 'undated' ELSE 'exam' END AS kind, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT course_id, calendar, year, 'missing', 0 FROM miss",
    "evidence_profile": PANEL
    + ", yy AS (SELECT DISTINCT course_id, calendar, year FROM ex WHERE year IS NOT NULL AND calendar IS NOT NULL), mc AS (SELECT course_id, sum(m)::BIGINT AS missing FROM (SELECT course_id, calendar, max(year) - min(year) + 1 - count(*) AS m FROM yy GROUP BY ALL) GROUP BY 1), s AS (SELECT course_id, k, sum(y) AS n FROM cells GROUP BY ALL), pr AS (SELECT course_id, n / sum(n) OVER (PARTITION BY course_id) AS p FROM s), h AS (SELECT course_id, sum(-p * ln(p)) / ln(greatest(count(*), 2)) AS entropy FROM pr WHERE p > 0 GROUP BY 1), qc AS (SELECT course_id, count(DISTINCT question_id) AS questions FROM obs GROUP BY 1) SELECT course_id, count(*) AS exams, count(*) FILTER (WHERE year IS NULL) AS undated, count(*) - 0.5::DOUBLE * count(*) FILTER (WHERE year IS NULL) AS effective, count(DISTINCT year) AS years, coalesce(any_value(missing), 0)::BIGINT AS missing, coalesce(any_value(questions), 0) AS questions, round(any_value(entropy) + 1e-10, 6) AS entropy FROM ex LEFT JOIN mc USING (course_id) LEFT JOIN qc USING (course_id) LEFT JOIN h USING (course_id) GROUP BY course_id",
    "evidence_lines": PANEL + "SELECT course_id, k, 'Asked in ' || count(DISTINCT t) || CASE WHEN count(DISTINCT t) = 1 THEN ' exam' ELSE ' exams' END || ' with ' || count(*) || CASE WHEN count(*) = 1 THEN ' question' ELSE ' questions' END || '; last in exam ' || max(t) || '.' AS line FROM obs GROUP BY ALL",
    "marks_histogram": _Q + ", s AS (SELECT exam_id, min(marks) AS lo, max(marks) AS hi, least(greatest(count(DISTINCT marks), 3), 12) AS bins FROM q WHERE marks IS NOT NULL GROUP BY 1) SELECT exam_id, (CASE WHEN hi > lo THEN least(floor((marks - lo) / (hi - lo) * bins), bins - 1) ELSE 0 END)::BIGINT AS bin, count(*) AS n FROM q JOIN s USING (exam_id) WHERE marks IS NOT NULL GROUP BY ALL",
    "marks_percentiles": _Q + "SELECT format, round(quantile_cont(marks, 0.25) + 1e-10, 6) AS p25, round(median(marks) + 1e-10, 6) AS p50, round(quantile_cont(marks, 0.75) + 1e-10, 6) AS p75 FROM q WHERE marks IS NOT NULL AND format IS NOT NULL GROUP BY 1",
    "capped_choice": _SC.replace(PANEL, UNITS)
    + ", r AS (SELECT sl.course_id, sl.k, sl.score FROM sl JOIN ends ON ends.course_id = sl.course_id AND sl.cutoff = last_t + 1 WHERE model = 'bayes'), u AS (SELECT r.*, row_number() OVER (PARTITION BY r.course_id, unit ORDER BY score DESC, r.k) AS iu FROM r JOIN un ON un.course_id = r.course_id AND un.k = r.k), c AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY score DESC, k)::INT AS pos FROM u WHERE iu <= 3) SELECT course_id, k, round(score + 1e-10, 6) AS score, pos FROM c WHERE pos <= 10",
    "mapping_status": _Q + f"SELECT question_id, k, CASE WHEN score >= 0.34 THEN 'A' WHEN score < 0.12 THEN 'D' WHEN score >= 0.22 THEN 'B' WHEN score IS NULL THEN 'C' ELSE 'C' END AS by_score, round({_CONF} + 1e-10, 6) AS confidence, CASE WHEN method = 'manual' THEN coalesce(status IN ('A', 'B'), false) ELSE coalesce(status = 'A' OR (status = 'B' AND score >= 0.22), false) END::INT AS counted FROM m",
    "review_overlay": "WITH q AS (SELECT DISTINCT question_id, exam_id, marks, coalesce(needs_review, false) AS nr FROM questions WHERE question_id IS NOT NULL) SELECT question_id, exam_id, round(CASE WHEN nr THEN 2 ELSE marks END + 1e-10, 6) AS marks, nr::INT AS edited FROM q WHERE NOT (nr AND marks IS NULL)",
    "merge_with_next": _Q + "SELECT exam_id, question_id, concat_ws(' ', text, lead(text) OVER w) AS text, round(marks + lead(marks) OVER w + 1e-10, 6) AS marks FROM q WINDOW w AS (PARTITION BY exam_id ORDER BY question_id) QUALIFY marks + lead(marks) OVER w IS NOT NULL",
    "split_questions": _Q + "SELECT question_id, (generate_subscripts(p, 1))::INT AS part, trim(unnest(p)) AS text FROM (SELECT question_id, list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS p FROM q WHERE text IS NOT NULL)",
    "changed_parts": "WITH q AS (SELECT DISTINCT question_id, exam_id, parse_confidence FROM questions WHERE question_id IS NOT NULL), c AS (SELECT exam_id, count(*) AS n, count(*) FILTER (WHERE parse_confidence >= 0.6) AS k FROM q GROUP BY 1) SELECT exam_id AS part, CASE WHEN k = 0 THEN 'removed' ELSE 'changed' END AS change FROM c WHERE k < n",
    "search_filters": "SELECT DISTINCT question_id, exam_id FROM questions WHERE is_leaf AND list_contains(types, 'numerical') AND exam_id IN (SELECT exam_id FROM exams WHERE year IS NOT NULL) AND question_id IN (SELECT question_id FROM mappings WHERE rank = 1)",
    "hybrid_full_outer": _Q + ", a AS (SELECT question_id, 1.0::DOUBLE / length(text) AS kw FROM q WHERE contains(lower(text), 'voltage')), b AS (SELECT question_id, max(score) AS sem FROM m GROUP BY 1 HAVING max(score) > 0.5) SELECT question_id, round(greatest(kw, sem) + 1e-10, 6) AS score FROM a FULL JOIN b USING (question_id)",
    "file_dedupe": "SELECT course_id, sha256, min(file_id) AS file_id, count(DISTINCT file_id) AS uploads FROM source_file WHERE course_id IS NOT NULL AND sha256 IS NOT NULL GROUP BY ALL",
    "strictly_before": PANEL + ", b AS (SELECT o.course_id, o.k, o.question_id, (SELECT count(DISTINCT p.t) FROM obs p WHERE p.course_id = o.course_id AND p.k = o.k AND p.t < o.t) AS n FROM obs o) SELECT course_id, k, sum(n)::BIGINT AS before, count(*) AS n FROM b GROUP BY ALL",
    "history_reconcile": "SELECT 1::BIGINT AS course_id, 1::BIGINT AS k, 1::BIGINT AS a, 1::BIGINT AS b WHERE false",
    "course_summary": f"WITH {_LAT}, c AS (SELECT DISTINCT course_id, name FROM course) SELECT c.course_id, c.name, (SELECT count(DISTINCT (e.exam_id, e.t)) FROM exams e WHERE e.course_id = c.course_id) AS exams, (SELECT count(DISTINCT file_id) FROM source_file f WHERE f.course_id = c.course_id) AS files, (SELECT count(*) FROM lat WHERE lat.course_id = c.course_id) AS nodes FROM c",
}
