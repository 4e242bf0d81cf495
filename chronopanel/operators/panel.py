"""The entity-by-time panel: exams of a course in order, items, and what each exam holds of each item.

Everything computed for cutoff c sees steps before c alone. Statistics over history are window frames that end one row
before the current one, over cells with one more step at the end: the one to be forecast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORMATS = ("definition", "theory", "derivation", "numerical", "diagram", "objective", "mixed")
EXAM = ("course_id", "t", "exam_id", "ord", "label", "total_marks", "year", "calendar", "source_kind")


def exams_once(exams: DataFrame) -> DataFrame:
    """Exams without duplicate rows; rows without a course, step or id are dropped."""
    return exams.select(*EXAM).where("course_id is not null and t is not null and exam_id is not null").distinct()


def questions_once(questions: DataFrame, *columns: str) -> DataFrame:
    """One row a question: rows of the same question_id are identical."""
    return questions.where("question_id is not null").select("question_id", *columns).distinct()


def mappings_once(mappings: DataFrame) -> DataFrame:
    return mappings.where("question_id is not null and k is not null").select("question_id", "k", "node_id", "rank", "weight", "score", "status", "method").distinct()


def observations(exams: DataFrame, questions: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row a question and item: course_id, t, k, question_id, mass (the item's share of the question), marks (that
    share of its marks), soft, score, format, and the question's flags. An unknown format counts as theory."""
    q = questions_once(questions, "exam_id", "marks", "format", "parse_confidence", "is_optional", "exact_repeat", "para_repeat")
    m = mappings_once(mappings).withColumn("mass", F.col("weight") / F.sum("weight").over(W.partitionBy("question_id")))
    e = exams_once(exams).select("exam_id", "course_id", "t")
    known = F.when(F.col("format").isin(*FORMATS), F.col("format")).otherwise("theory")
    return m.join(q, "question_id").join(e, "exam_id").select(
        "course_id", "t", "k", "question_id", "rank", "mass", (F.col("marks") * F.col("mass")).alias("share"), F.col("marks").isNotNull().cast("long").alias("marks_known"),
        "score", "status", known.alias("format"), "parse_confidence", F.coalesce("is_optional", F.lit(False)).cast("long").alias("optional"),
        F.coalesce("exact_repeat", F.lit(False)).cast("long").alias("exact"), F.coalesce("para_repeat", F.lit(False)).cast("long").alias("para"),
    )


CELL_SUMS = ("y", "marks", "soft", "n_questions", "exact_repeat", "para_repeat", "semantic", "map_conf_sum", "parse_conf_sum", "marks_known_sum", "optional_sum")


def build_cells(exams: DataFrame, obs: DataFrame, future: bool = False) -> DataFrame:
    """Dense cells (course_id, t, k, ...): every exam of a course by every item that any of its exams holds.

    y is 1 if any question holds the item; marks and counts are sums, soft the greatest score, semantic the noisy or of
    the masses weighted by score. future adds the step after the last exam, all zero, to forecast at.
    """
    m = F.least(F.greatest(F.col("score") * F.col("mass"), F.lit(0.0)), F.lit(0.999))
    agg = obs.groupBy("course_id", "t", "k").agg(
        F.lit(1).cast("long").alias("y"), F.sum("share").alias("marks"), F.max("score").alias("soft"), F.count("*").alias("n_questions"), F.sum("exact").alias("exact_repeat"),
        F.sum("para").alias("para_repeat"), (1 - F.exp(F.sum(F.log1p(-F.coalesce(m, F.lit(0.0)))))).alias("semantic"), F.sum("score").alias("map_conf_sum"),
        F.sum("parse_confidence").alias("parse_conf_sum"), F.sum("marks_known").alias("marks_known_sum"), F.sum("optional").alias("optional_sum"),
    )
    steps = exams_once(exams).select("course_id", "t")
    if future:
        steps = steps.unionByName(steps.groupBy("course_id").agg((F.max("t") + 1).cast("int").alias("t")))
    items = agg.select("course_id", "k").distinct()
    dense = steps.join(items, "course_id").join(agg, ["course_id", "t", "k"], "left")
    return dense.select("course_id", "t", "k", *[F.coalesce(c, F.lit(0)).alias(c) for c in CELL_SUMS])


def cell_formats(obs: DataFrame) -> DataFrame:
    """course_id, t, k and one count a format."""
    return obs.groupBy("course_id", "t", "k").agg(*[F.count(F.when(F.col("format") == f, 1)).alias(f) for f in FORMATS])


def before(order: str = "t", *keys: str) -> W:
    """The frame of all earlier steps."""
    return W.partitionBy(*(keys or ("course_id", "k"))).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def last(n: int) -> W:
    return W.partitionBy("course_id", "k").orderBy("t").rowsBetween(-n, -1)


def average_percentile(score: Column, *keys: str) -> Column:
    """(average rank - 1) / (n - 1) in a group; 0.5 for a single row. Ties share the mean of their ranks."""
    w = W.partitionBy(*keys)
    ties = F.count("*").over(W.partitionBy(*keys, score))
    n = F.count("*").over(w)
    return F.when(n <= 1, F.lit(0.5)).otherwise((F.rank().over(w.orderBy(score)) - 1 + (ties - 1) / 2) / (n - 1))


def resolve_top_k(cells: DataFrame) -> DataFrame:
    """course_id, k: the rounded (half to even) median number of items in exams that hold any, between 3 and 15 and at
    most the number of items; courses whose exams hold none are left out."""
    per = cells.groupBy("course_id", "t").agg(F.sum("y").alias("n")).where("n > 0").groupBy("course_id").agg(F.bround(F.median("n")).cast("long").alias("m"))
    size = cells.groupBy("course_id").agg(F.count_distinct("k").alias("size"))
    return per.join(size, "course_id").select("course_id", F.least(F.greatest(F.least("m", F.lit(15)), F.lit(3)), "size").alias("top_k"))


def known_top_k(cells: DataFrame) -> DataFrame:
    """course_id, cutoff, top_k of resolve_top_k(), from the exams before each cutoff alone."""
    per = cells.groupBy("course_id", "t").agg(F.sum("y").alias("n"))
    size = cells.groupBy("course_id").agg(F.count_distinct("k").alias("size"))
    earlier = per.select(F.col("course_id").alias("_c"), F.col("t").alias("_t"), F.when(F.col("n") > 0, F.col("n")).alias("_n"))
    m = per.join(earlier, (F.col("course_id") == F.col("_c")) & (F.col("_t") < F.col("t")), "left").groupBy("course_id", F.col("t").alias("cutoff")).agg(F.bround(F.median("_n")).cast("long").alias("m"))
    return m.join(size, "course_id").select("course_id", "cutoff", F.least(F.greatest(F.least(F.coalesce("m", F.lit(3)), F.lit(15)), F.lit(3)), "size").alias("top_k"))


def drop_exam(cells: DataFrame) -> DataFrame:
    """course_id, dropped, t, k, y: the panel without each exam in turn, the later steps moved up."""
    js = cells.select("course_id", F.col("t").alias("dropped")).distinct()
    return cells.join(js, "course_id").where("t <> dropped").select("course_id", "dropped", (F.col("t") - (F.col("t") > F.col("dropped")).cast("int")).alias("t"), "k", "y")


def training_rows(features: DataFrame, min_history: int = 2) -> DataFrame:
    """target and the feature rows of every earlier cutoff from min_history on."""
    targets = features.select("course_id", F.col("cutoff").alias("target")).distinct()
    return features.join(targets, "course_id").where((F.col("cutoff") < F.col("target")) & (F.col("cutoff") >= min_history))
