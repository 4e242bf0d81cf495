"""Queries of vectors, search, alignment and recurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import text as T
from chronopanel.operators import alignment as A
from chronopanel.operators import panel as P
from chronopanel.operators import recurrence as R
from chronopanel.operators import trees
from chronopanel.operators import vectors as V
from chronopanel.operators.hierarchy import descendant_pairs, hierarchy
from chronopanel.plans.panels import PANEL, observations, rounded
from chronopanel.plans.reporting import _LAT, facts, questions
from chronopanel.plans.texts import _KEPT, _ORDERED
from chronopanel.sources.tables import cut, table


def node_terms(spark, d):
    docs = trees.node_documents(facts(spark, d))
    return V.term_counts(docs, "node_id", T.tokens(F.col("document")))


def question_terms(spark, d):
    return V.term_counts(questions(spark, d, "text").where("text is not null"), "question_id", T.tokens(F.col("text")))


def _scoped(spark, d):
    """Distinct content terms of the questions of each course."""
    e = observations(spark, d).select("question_id", "course_id").distinct()
    q = questions(spark, d, "text").join(e, "question_id")
    return q.select("course_id", "question_id", F.explode(T.content_terms(F.col("text"), False)).alias("term"))


def _aligned(spark, d):
    """Questions against the nodes of their course, by content terms."""
    course = P.exams_once(table(spark, d, "exams")).select("exam_id", "course_id")
    q = questions(spark, d, "exam_id", "text").where("text is not null").join(course, "exam_id")
    q = q.select("course_id", "question_id", F.explode(T.content_terms(F.col("text"), False)).alias("term"), F.lit(1).alias("tf"))
    f = facts(spark, d)
    n = f.select("node_id", "course_id").join(trees.node_documents(f), "node_id").where("course_id is not null")
    n = n.select("course_id", "node_id", F.explode(T.content_terms(F.col("document"), False)).alias("term"), F.lit(1).alias("tf"))
    return V.align(q, n)


def aligner(spark, d):
    """The questions of each course, with their contexts, against the nodes of its syllabuses."""
    course = P.exams_once(table(spark, d, "exams")).select("exam_id", "course_id", "t")
    q = questions(spark, d, "exam_id", "text", "parent_id").where("text is not null")
    q = q.join(trees.context_texts(q.select("question_id", "text", "parent_id")), "question_id").join(course, "exam_id")
    lab = F.coalesce(F.col("context"), F.lit("")).rlike(A.LAB_CUE)
    numbers = F.regexp_count("context", F.lit(r"\d\s*(?:[kmg]?(?:pa|n|j|w|v|a|hz|m|kg|s)|mm|cm|ohm|bar|rpm|litres|min|mol)\b"))
    both = q.select("course_id", "question_id", "t", lab.alias("lab_cue"), numbers.alias("numbers"), T.content_terms(F.col("text"), False).alias("own"), T.content_terms(F.col("context"), False).alias("around"))
    terms = both.select("course_id", "question_id", "t", "lab_cue", "numbers", "own", F.explode(F.array_union("own", "around")).alias("term"))
    terms = terms.select("course_id", "question_id", "t", "lab_cue", "numbers", "term", F.array_contains("own", F.col("term")).cast("int").alias("own"), F.lit(1).alias("around")).distinct()
    f = facts(spark, d)
    n = f.where("course_id is not null").select("node_id", "course_id", F.coalesce(F.array_contains("kinds", "lab"), F.lit(False)).alias("is_lab")).join(trees.node_documents(f), "node_id")
    n = n.select("course_id", "node_id", "is_lab", F.explode(T.content_terms(F.col("document"), False)).alias("term"), F.lit(1).alias("tf"))
    pairs = cut(descendant_pairs(hierarchy(table(spark, d, "tree"), paths=False)).select("ancestor_id", "node_id"))
    return A.Aligner(terms, n, pairs)


def _links(spark, d):
    return R.recurrence_links(_scoped(spark, d), ["course_id"])


def _papers(spark, d):
    """Leaf questions of the exams of each course, as they are compared."""
    course = P.exams_once(table(spark, d, "exams")).select("exam_id", "course_id")
    q = questions(spark, d, "exam_id", "text", "is_leaf").where("is_leaf").join(course, "exam_id")
    return q.select("course_id", "exam_id", "question_id", T.normalize_for_matching(F.col("text")).alias("text"))


def _search(spark, d):
    q = spark.createDataFrame([(1, "volt"), (1, "pump"), (2, "visco"), (2, "rotor"), (3, "of")], "query_id long, prefix string")
    s = V.bm25(question_terms(spark, d), "question_id", q)
    s = s.withColumn("score", F.round("score", 9))
    return rounded(V.top_matches(s, "query_id", "question_id", 50, "score"))


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return V.vector_search(v, "vec_id", "embedding", v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


def _fuzzy(spark, d):
    """Titles of the same syllabus that share a word, with their edit ratios."""
    p = R.title_pairs(facts(spark, d).select("course_id", "node_id", "title"), "course_id")
    return rounded(p.select("n1", "n2", R.fuzzy_ratios(F.lower("t1"), F.lower("t2")).alias("r")).select("n1", "n2", "r.*"))


def _centroid_similarity(spark, d):
    """Cosine of the centroids of any two labels, and of each label with the mean of all."""
    c = V.centroids(table(spark, d, "embeddings"), "label", "embedding", 64)
    norm = c.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("len"))
    x = c.join(norm, "label").select("label", "dim", (F.col("mean") / F.col("len")).alias("v"))
    y = x.select(F.col("label").alias("other"), "dim", F.col("v").alias("u"))
    return rounded(x.join(y, "dim").where("label < other").groupBy("label", "other").agg(F.sum(F.col("v") * F.col("u")).alias("sim")))


QUERIES = {
    "term_counts": lambda s, d: question_terms(s, d),
    "tfidf_nodes": lambda s, d: rounded(V.tfidf(node_terms(s, d), "node_id")),
    "char_vectors": lambda s, d: rounded(V.tfidf(V.term_counts(facts(s, d).where("title is not null"), "node_id", V.char_ngrams(F.col("title"))), "node_id").groupBy("node_id").agg(F.count("*").alias("n"), F.sum("w").alias("w"))),
    "align_questions": lambda s, d: rounded(_aligned(s, d)),
    "align_status": lambda s, d: rounded(aligner(s, d).run(feedback=False)),
    "align_causal": lambda s, d: rounded(aligner(s, d).run()),
    "unknown_terms": lambda s, d: rounded(V.unknown_terms(question_terms(s, d), node_terms(s, d))),
    "bm25_search": _search,
    "vector_search": lambda s, d: rounded(_vectors(s, d)),
    "label_centroids": lambda s, d: rounded(V.centroids(table(s, d, "embeddings"), "label", "embedding", 64)),
    "centroid_similarity": _centroid_similarity,
    "recurrence_links": lambda s, d: rounded(_links(s, d)),
    "recurrence_families": lambda s, d: R.components(_links(s, d).where("relation <> 'concept'")),
    "duplicate_exams": lambda s, d: rounded(R.duplicate_exams(_papers(s, d))),
    "fuzzy_titles": _fuzzy,
}

_QT = "qt AS (SELECT question_id, term, count(*) AS tf FROM (SELECT question_id, unnest(regexp_extract_all(lower(text), '[\\p{L}][\\p{L}\\p{N}]*|[0-9]+(?:\\.[0-9]+)?')) AS term FROM (SELECT DISTINCT question_id, text FROM questions WHERE text IS NOT NULL)) GROUP BY ALL)"
_NT = _LAT + ", nt AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, title, coalesce(array_to_string(concepts, ' '), ''), ptitle)), '[\\p{L}][\\p{L}\\p{N}]*|[0-9]+(?:\\.[0-9]+)?')) AS term FROM (SELECT a.*, p.title AS ptitle FROM lat a LEFT JOIN lat p ON a.parent_id = p.node_id)) GROUP BY ALL), idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT node_id) FROM nt)) / (1 + count(*))) + 1 AS idf FROM nt GROUP BY 1), nv AS (SELECT node_id, term, (1 + ln(tf)) * idf / sqrt(sum(pow((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY node_id)) AS w FROM nt JOIN idf USING (term))"
_LK = f""", ct AS (SELECT question_id, course_id, unnest({_ORDERED}) AS term FROM (SELECT q.question_id, o.course_id, {_KEPT} AS l FROM (SELECT DISTINCT question_id, text FROM questions WHERE text IS NOT NULL) q JOIN (SELECT DISTINCT question_id, course_id FROM obs) o USING (question_id))),
cn AS (SELECT course_id, question_id, count(*) AS n FROM ct GROUP BY ALL), cb AS (SELECT a.course_id, a.question_id AS id_1, b.question_id AS id_2, count(*) AS b FROM ct a JOIN ct b ON a.course_id = b.course_id AND a.term = b.term AND a.question_id < b.question_id GROUP BY ALL),
lk AS (SELECT cb.course_id, id_1, id_2, b / (x.n + y.n - b) AS sim FROM cb JOIN cn x ON x.course_id = cb.course_id AND x.question_id = id_1 JOIN cn y ON y.course_id = cb.course_id AND y.question_id = id_2 WHERE b / (x.n + y.n - b) >= 0.4) """
ORACLES = {
    "term_counts": f"WITH {_QT} SELECT * FROM qt",
    "tfidf_nodes": f"WITH {_NT} SELECT node_id, term, round(w + 1e-10, 6) AS w FROM nv",
    "align_questions": f"""WITH {_LAT}, q AS (SELECT course_id, question_id, unnest({_ORDERED}) AS term FROM (SELECT e.course_id, q.question_id, {_KEPT} AS l FROM (SELECT DISTINCT question_id, exam_id, text FROM questions WHERE text IS NOT NULL) q JOIN (SELECT DISTINCT exam_id, course_id FROM exams) e USING (exam_id))),
    n AS (SELECT course_id, node_id, unnest({_ORDERED}) AS term FROM (SELECT course_id, node_id, {_KEPT} AS l FROM (SELECT a.course_id, a.node_id, concat_ws(' ', a.title, a.title, coalesce(array_to_string(a.concepts, ' '), ''), p.title) AS text FROM lat a LEFT JOIN lat p ON a.parent_id = p.node_id WHERE a.course_id IS NOT NULL))),
    sz AS (SELECT course_id, count(DISTINCT node_id) AS n FROM n GROUP BY 1), idf AS (SELECT course_id, term, ln((1 + any_value(sz.n)) / (1 + count(*))) + 1 AS idf FROM n JOIN sz USING (course_id) GROUP BY ALL),
    qv AS (SELECT q.*, idf, idf / sqrt(sum(idf * idf) OVER (PARTITION BY question_id)) AS w, sum(idf) OVER (PARTITION BY question_id) AS total FROM q JOIN idf USING (course_id, term)), nv AS (SELECT n.*, idf / sqrt(sum(idf * idf) OVER (PARTITION BY node_id)) AS w FROM n JOIN idf USING (course_id, term)),
    p AS (SELECT question_id, node_id, sum(qv.w * nv.w) AS sim, sum(qv.idf) / any_value(total) AS coverage FROM qv JOIN nv USING (course_id, term) GROUP BY ALL), s AS (SELECT *, round(0.6::DOUBLE * greatest(sim, 0) + 0.4::DOUBLE * coverage, 9) AS score FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id)::INT AS rank FROM s) SELECT question_id, node_id, rank, round(score + 1e-10, 6) AS score, round(sim + 1e-10, 6) AS sim, round(coverage + 1e-10, 6) AS coverage FROM r WHERE rank <= 2""",
    "unknown_terms": f"WITH {_QT}, {_NT} SELECT question_id, count(*) FILTER (WHERE idf.term IS NULL) AS unknown, round(count(*) FILTER (WHERE idf.term IS NULL) / count(*) + 1e-10, 6) AS share FROM qt LEFT JOIN idf USING (term) GROUP BY 1",
    "bm25_search": f"""WITH {_QT}, ln AS (SELECT question_id, sum(tf) AS len FROM qt GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS av FROM ln), df AS (SELECT term, count(*) AS df FROM qt GROUP BY 1), qs(query_id, prefix) AS (VALUES (1, 'volt'), (1, 'pump'), (2, 'visco'), (2, 'rotor'), (3, 'of')),
    h AS (SELECT DISTINCT query_id, term, df FROM qs JOIN df ON CASE WHEN length(prefix) < 3 THEN term = prefix ELSE starts_with(term, prefix) END), s AS (SELECT query_id::BIGINT AS query_id, question_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), 9) AS score FROM qt JOIN h USING (term) JOIN ln USING (question_id), st GROUP BY ALL)
    SELECT query_id, question_id, round(score + 1e-10, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, question_id)::INT AS rank FROM s) WHERE rank <= 50""",
    "vector_search": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v, v q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, rank, round(score + 1e-10, 6) AS score FROM r WHERE rank <= 10",
    "label_centroids": "SELECT label, dim, round(avg(x) + 1e-10, 6) AS mean FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL",
    "centroid_similarity": "WITH c AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL), v AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS v FROM c) SELECT a.label, b.label AS other, round(sum(a.v * b.v) + 1e-10, 6) AS sim FROM v a JOIN v b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL",
    "recurrence_links": PANEL + _LK + "SELECT course_id, id_1, id_2, round(sim + 1e-10, 6) AS sim, CASE WHEN sim >= 0.86 THEN 'exact' WHEN sim >= 0.55 THEN 'paraphrase' ELSE 'concept' END AS relation FROM lk",
    "recurrence_families": PANEL.replace("WITH ex", "WITH RECURSIVE ex", 1)
    + _LK
    + ", g AS (SELECT id_1 AS a, id_2 AS b FROM lk WHERE sim >= 0.55 UNION SELECT id_2, id_1 FROM lk WHERE sim >= 0.55), r AS (SELECT a AS id, b FROM g UNION SELECT r.id, g.b FROM r JOIN g ON r.b = g.a) SELECT id, least(id, min(b)) AS component, (SELECT count(*) FROM g WHERE g.a = r.id) AS links FROM r GROUP BY id",
}
