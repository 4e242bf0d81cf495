"""Queries of the read model: what a page of the application shows, as views over the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.functions import text as T
from chronopanel.operators import panel as P
from chronopanel.operators import reports as R
from chronopanel.operators import vectors as V
from chronopanel.plans.forecasts import _history
from chronopanel.plans.panels import PANEL, exams, observations, rounded
from chronopanel.plans.reporting import _LAT, _Q, facts, maps, questions
from chronopanel.plans.texts import _KEPT, _ORDERED, CLEAN_QUESTION, FLAG_COLUMNS, FLAG_LIST
from chronopanel.sources.tables import table


def _tree(spark, d):
    """Questions under their parents, flat: the parent's children in order, joined."""
    q = questions(spark, d, "parent_id").where("parent_id is not null")
    kids = q.groupBy("parent_id").agg(F.array_sort(F.collect_list("question_id")).alias("kids"))
    return kids.select(F.col("parent_id").alias("question_id"), F.array_join(F.col("kids").cast("array<string>"), ",").alias("children"), F.size("kids").cast("long").alias("n"))


def _manual(spark, d):
    """The mapping that counts for each question: manual ones before automatic, then by rank."""
    m = maps(spark, d)
    r = F.row_number().over(W.partitionBy("question_id").orderBy(F.when(F.col("method") == "manual", 0).otherwise(1), "rank", "k"))
    q = questions(spark, d, "exam_id")
    best = m.withColumn("r", r).where("r = 1").select("question_id", "k", "method")
    return q.join(best, "question_id", "left")


def _mass(spark, d):
    """Softmax of a question's scores (temperature 0.05) over its items; parts below 0.01 are dropped, the rest made whole."""
    m = maps(spark, d).where("score is not null")
    w = W.partitionBy("question_id")
    x = m.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / 0.05))
    x = x.withColumn("p", F.col("e") / F.sum("e").over(w)).where("p >= 0.01")
    return rounded(x.select("question_id", "k", (F.col("p") / F.sum("p").over(w)).alias("mass")))


def _openers(spark, d):
    """The most frequent first word of questions of each format."""
    q = questions(spark, d, "format", "text").where("format is not null")
    w = F.regexp_extract(F.lower(T.clean_question(F.col("text"))), r"^([a-z]+)", 1)
    c = q.select("format", w.alias("opener")).where("opener <> ''").groupBy("format", "opener").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(W.partitionBy("format").orderBy(F.desc("n"), "opener"))).where("r <= 3").select("format", "opener", "n", "r")


def _relation(spark, d):
    """How a question relates to the past, by its flags: exact before paraphrase before new; the flags of an older run."""
    q = questions(spark, d, "exact_repeat", "para_repeat")
    return q.select("question_id", F.when(F.col("exact_repeat"), "exact").when(F.col("para_repeat"), "paraphrase").when(F.col("exact_repeat").isNull() & F.col("para_repeat").isNull(), "unknown").otherwise("new").alias("relation"))


def _grounding(spark, d):
    """Questions of which every content term stands in the title or concepts of their main node."""
    q = questions(spark, d, "text").where("text is not null").select("question_id", F.explode(T.content_terms(F.col("text"), False)).alias("term"))
    m = maps(spark, d).where("rank = 1").select("question_id", "node_id")
    f = facts(spark, d).select("node_id", F.explode(T.content_terms(F.concat_ws(" ", "title", F.array_join("concepts", " ")), False)).alias("known"))
    x = q.join(m, "question_id").join(f, (m["node_id"] == f["node_id"]) & (q["term"] == f["known"]), "left")
    return x.groupBy("question_id").agg(F.count("*").alias("terms"), F.count("known").alias("grounded"))


def _lineage(spark, d):
    """Where a page comes from: file, course, whether its file was read."""
    p = table(spark, d, "document_page").where("page_id is not null").select("page_id", "file_id", "page_no").distinct()
    f = table(spark, d, "source_file").select(F.col("file_id").alias("f"), "filename", "course_id", "status").distinct()
    c = table(spark, d, "course").select(F.col("course_id").alias("c"), "name").distinct()
    x = p.join(f, p["file_id"] == f["f"], "left").join(c, f["course_id"] == c["c"], "left")
    return x.select("page_id", F.concat_ws(", p. ", "filename", F.col("page_no").cast("string")).alias("place"), "name", F.coalesce("status", F.lit("missing")).alias("status"))


def _needs_review(spark, d):
    q = questions(spark, d, "exam_id", "parse_confidence", "needs_review", "text")
    flags = T.text_flags(F.col("text"))
    serious = F.size(F.array_intersect(flags, F.array(*[F.lit(f) for f in ("empty", "garbled", "implausible")]))) > 0
    return q.select("question_id", (serious | (F.coalesce("parse_confidence", F.lit(0.0)) < 0.7)).cast("int").alias("review"), F.coalesce(F.col("needs_review"), F.lit(False)).cast("int").alias("stored"))


def _paper_quality(spark, d):
    """course_id, t, reasons: why an exam's figures are provisional."""
    e = P.exams_once(exams(spark, d))
    q = _needs_review(spark, d).join(questions(spark, d, "exam_id"), "question_id").groupBy("exam_id").agg(F.sum("review").alias("review"), F.count("*").alias("n"))
    x = e.join(q, "exam_id", "left")
    r = F.filter(F.array(F.when(F.col("year").isNull(), "undated"), F.when(F.col("total_marks").isNull(), "marks unknown"), F.when(F.coalesce("review", F.lit(0)) > 0, F.concat(F.col("review").cast("string"), F.lit(" to review")))), lambda v: v.isNotNull())
    return x.select("course_id", "t", F.array_join(r, "; ").alias("reasons"), F.coalesce("n", F.lit(0)).alias("questions"))


def _related(spark, d):
    """The three best-scored questions of each item of a course."""
    o = observations(spark, d).where("score is not null")
    r = F.row_number().over(W.partitionBy("course_id", "k").orderBy(F.desc("score"), "question_id"))
    return rounded(o.withColumn("r", r).where("r <= 3").select("course_id", "k", "question_id", "score", F.col("r").alias("pos")))


def _others(spark, d):
    """Rows of all other real courses, for each course: how many there are to learn from."""
    per = observations(spark, d).groupBy("course_id").agg(F.count("*").alias("rows"))
    real = table(spark, d, "course").where("not is_synthetic").select("course_id").distinct()
    own = per.join(real, "course_id", "left_semi")
    total = F.sum("rows").over(W.partitionBy(F.lit(0)))  # a row a course
    return own.select("course_id", "rows", (total - F.col("rows")).alias("others"))


def _hybrid(spark, d):
    """Two cosines of embeddings blended: of all dimensions and of the first half, 0.3 to 0.7, against the label's first vector."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    a = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    x = e.join(a, "label")
    cos = lambda p, q: V.dot(p, q) / F.sqrt(V.dot(p, p) * V.dot(q, q))
    x = x.withColumn("h1", F.slice("embedding", 1, 32)).withColumn("h2", F.slice("anchor", 1, 32))
    return rounded(x.select("vec_id", (0.3 * cos("embedding", "anchor") + 0.7 * cos("h1", "h2")).alias("sim")))


def _excluded(spark, d):
    """Questions whose mappings are all out of the syllabus (D), by course and format."""
    o = observations(spark, d).groupBy("course_id", "question_id", "format").agg(F.min(F.coalesce("status", F.lit("?"))).alias("best"))
    return o.where("best = 'D'").groupBy("course_id", "format").agg(F.count("*").alias("n"), F.min("question_id").alias("example"))


def _latest_files(spark, d):
    """The last good upload of each content of a course."""
    f = table(spark, d, "source_file").where("status = 'done' and course_id is not null")
    return f.groupBy("course_id", "sha256").agg(F.max_by("file_id", F.struct("uploaded_at", "file_id")).alias("file_id"), F.max("page_count").alias("pages"))


QUERIES = {
    "question_tree": _tree,
    "manual_first": _manual,
    "semantic_mass": _mass,
    "openers": _openers,
    "relation_flags": _relation,
    "grounding": _grounding,
    "page_lineage": _lineage,
    "needs_review": _needs_review,
    "paper_quality": _paper_quality,
    "related_evidence": _related,
    "other_courses": _others,
    "hybrid_similarity": _hybrid,
    "excluded_groups": _excluded,
    "latest_files": _latest_files,
    "supporting_signals": lambda s, d: R.supporting_signals(_history(s, d)),
    "vector_cache_keys": lambda s, d: questions(s, d, "text").select(F.sha2(F.concat(F.lit("tfidf|"), F.coalesce("text", F.lit(""))), 256).alias("key")).groupBy("key").agg(F.count("*").alias("n")),
    "status_filter": lambda s, d: maps(s, d).groupBy(F.coalesce("status", F.lit("unknown")).alias("status"), "method").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("questions")),
    "title_union": lambda s, d: facts(s, d).where("course_id is not null").select("course_id", F.explode(F.array_union("concepts", "kinds")).alias("word")).select("course_id", F.lower("word").alias("word")).distinct(),
    "missing_reports": lambda s, d: table(s, d, "document_page").where("page_id is not null").select("page_id").distinct().join(table(s, d, "quality_report").select("page_id").distinct(), "page_id", "left_anti"),
    "clean_numbers": lambda s, d: rounded(table(s, d, "quality_report").groupBy("page_id").agg(F.max(F.when(F.isnan("symbol_ratio"), None).otherwise(F.col("symbol_ratio"))).alias("symbol_ratio"), F.max("words").alias("words"))),
}

_R6 = "+ 1e-10, 6)"
_SER = "len(list_filter(f, lambda v: v IN ('empty', 'garbled', 'implausible'))) > 0"
_NR = (
    "WITH q AS (SELECT DISTINCT question_id, exam_id, text, parse_confidence, needs_review, NULL::DOUBLE AS ocr_confidence FROM questions WHERE question_id IS NOT NULL), fl AS (SELECT question_id, exam_id, parse_confidence, needs_review, "
    + FLAG_LIST
    + " AS f FROM (SELECT *, "
    + FLAG_COLUMNS
    + f" FROM q)), nr AS (SELECT question_id, exam_id, ({_SER} OR coalesce(parse_confidence, 0) < 0.7)::INT AS review, coalesce(needs_review, false)::INT AS stored FROM fl) "
)
ORACLES = {
    "question_tree": _Q + "SELECT parent_id AS question_id, string_agg(question_id, ',' ORDER BY question_id) AS children, count(*) AS n FROM q WHERE parent_id IS NOT NULL GROUP BY 1",
    "manual_first": _Q + "SELECT q.question_id, q.exam_id, b.k, b.method FROM q LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN method = 'manual' THEN 0 ELSE 1 END, rank, k) = 1) b USING (question_id)",
    "semantic_mass": _Q
    + f", ee AS (SELECT question_id, k, exp((score - max(score) OVER w) / 0.05) AS e FROM m WHERE score IS NOT NULL WINDOW w AS (PARTITION BY question_id)), p AS (SELECT question_id, k, e / sum(e) OVER (PARTITION BY question_id) AS p FROM ee) SELECT question_id, k, round(p / sum(p) OVER (PARTITION BY question_id) {_R6} AS mass FROM p WHERE p >= 0.01",
    "openers": _Q
    + "SELECT format, opener, n, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY format ORDER BY n DESC, opener) AS r FROM (SELECT format, opener, count(*) AS n FROM (SELECT format, regexp_extract(lower(t), '^([a-z]+)', 1) AS opener FROM (SELECT format, "
    + CLEAN_QUESTION
    + " AS t FROM q WHERE format IS NOT NULL)) WHERE opener <> '' GROUP BY ALL)) WHERE r <= 3",
    "relation_flags": "SELECT DISTINCT question_id, CASE WHEN exact_repeat THEN 'exact' WHEN para_repeat THEN 'paraphrase' WHEN exact_repeat IS NULL AND para_repeat IS NULL THEN 'unknown' ELSE 'new' END AS relation FROM questions WHERE question_id IS NOT NULL",
    "grounding": f"WITH {_LAT}, m AS (SELECT DISTINCT question_id, node_id FROM mappings WHERE rank = 1), q AS (SELECT question_id, unnest({_ORDERED}) AS term FROM (SELECT question_id, {_KEPT} AS l FROM (SELECT DISTINCT question_id, text FROM questions WHERE text IS NOT NULL))), f AS (SELECT node_id, unnest({_ORDERED}) AS known FROM (SELECT node_id, {_KEPT} AS l FROM (SELECT node_id, concat_ws(' ', title, coalesce(array_to_string(concepts, ' '), '')) AS text FROM lat))) SELECT question_id, count(*) AS terms, count(known) AS grounded FROM q JOIN m USING (question_id) LEFT JOIN f ON f.node_id = m.node_id AND f.known = q.term GROUP BY 1",
    "page_lineage": "SELECT p.page_id, concat_ws(', p. ', f.filename, p.page_no) AS place, c.name, coalesce(f.status, 'missing') AS status FROM (SELECT DISTINCT page_id, file_id, page_no FROM document_page WHERE page_id IS NOT NULL) p LEFT JOIN (SELECT DISTINCT file_id, filename, course_id, status FROM source_file) f USING (file_id) LEFT JOIN (SELECT DISTINCT course_id, name FROM course) c ON c.course_id = f.course_id",
    "needs_review": _NR + "SELECT question_id, review, stored FROM nr",
    "paper_quality": _NR
    + ", e AS (SELECT DISTINCT course_id, t, exam_id, year, total_marks FROM exams), c AS (SELECT exam_id, sum(review)::BIGINT AS review, count(*) AS n FROM nr GROUP BY 1) SELECT course_id, t, concat_ws('; ', CASE WHEN year IS NULL THEN 'undated' END, CASE WHEN total_marks IS NULL THEN 'marks unknown' END, CASE WHEN review > 0 THEN review || ' to review' END) AS reasons, coalesce(n, 0) AS questions FROM e LEFT JOIN c USING (exam_id)",
    "related_evidence": PANEL + f"SELECT course_id, k, question_id, round(score {_R6} AS score, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY course_id, k ORDER BY score DESC, question_id) AS pos FROM obs WHERE score IS NOT NULL) WHERE pos <= 3",
    "other_courses": PANEL + "SELECT course_id, count(*) AS rows, (sum(count(*)) OVER () - count(*))::BIGINT AS others FROM obs WHERE course_id IN (SELECT course_id FROM course WHERE NOT is_synthetic) GROUP BY 1",
    "hybrid_similarity": f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT label, min_by(v, vec_id) AS w FROM e GROUP BY 1) SELECT vec_id, round(0.3::DOUBLE * list_cosine_similarity(v, w) + 0.7::DOUBLE * list_cosine_similarity(v[1:32], w[1:32]) {_R6} AS sim FROM e JOIN a USING (label)",
    "excluded_groups": PANEL + "SELECT course_id, format, count(*) AS n, min(question_id) AS example FROM (SELECT course_id, question_id, format, min(coalesce(status, '?')) AS best FROM obs GROUP BY ALL) WHERE best = 'D' GROUP BY ALL",
    "latest_files": "SELECT course_id, sha256, arg_max(file_id, (uploaded_at, file_id)) AS file_id, max(page_count) AS pages FROM source_file WHERE status = 'done' AND course_id IS NOT NULL GROUP BY ALL",
    "vector_cache_keys": _Q + "SELECT sha256('tfidf|' || coalesce(text, '')) AS key, count(*) AS n FROM q GROUP BY 1",
    "status_filter": _Q + "SELECT coalesce(status, 'unknown') AS status, method, count(*) AS n, count(DISTINCT question_id) AS questions FROM m GROUP BY ALL",
    "title_union": f"WITH {_LAT} SELECT DISTINCT course_id, lower(w) AS word FROM (SELECT course_id, unnest(list_concat(concepts, kinds)) AS w FROM lat WHERE course_id IS NOT NULL)",
    "missing_reports": "SELECT DISTINCT page_id FROM document_page WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT page_id FROM quality_report WHERE page_id IS NOT NULL)",
    "clean_numbers": f"SELECT page_id, round(max(CASE WHEN isnan(symbol_ratio) THEN NULL ELSE symbol_ratio END) {_R6} AS symbol_ratio, max(words) AS words FROM quality_report GROUP BY 1",
}
