"""Reporting over a course's past: history, coverage, structure, format forecasts, explanations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.functions.numerics import fisher_two_sided
from chronopanel.operators.metrics import benjamini_hochberg
from chronopanel.operators.panel import FORMATS


def node_stats(obs: DataFrame) -> DataFrame:
    """Per course and item: exams, questions, roles by rank, exams with it in a minor role alone, first and last exam,
    marks and repeats."""
    per = obs.groupBy("course_id", "k", "t").agg(F.max(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("main"))
    minor = per.groupBy("course_id", "k").agg(F.count(F.when(F.col("main") == 0, 1)).alias("minor_exams"))
    x = obs.groupBy("course_id", "k").agg(
        F.count_distinct("t").alias("exams"), F.count("*").alias("questions"), F.count(F.when(F.col("rank") == 1, 1)).alias("main_questions"), F.count(F.when(F.col("rank") != 1, 1)).alias("minor_questions"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("share").alias("marks_min"), F.max("share").alias("marks_max"), F.median("share").alias("marks_median"),
        F.count_distinct("format").alias("formats"), F.sum("exact").alias("exact_repeats"), F.sum("para").alias("para_repeats"),
    )
    return x.join(minor, ["course_id", "k"])


def unit_coverage(obs: DataFrame, units: DataFrame) -> DataFrame:
    """course_id, t, unit, marks, share, balance: marks of a unit in each exam, and how even the marks lie over the units
    of the course (entropy by that of all its units alike; 1 for a course of a single unit). Units without marks in an
    exam have no row. units: course_id, k, unit."""
    size = units.groupBy("course_id").agg(F.count_distinct("unit").alias("n_units"))
    per = obs.join(units, ["course_id", "k"]).groupBy("course_id", "t", "unit").agg(F.sum("share").alias("marks")).where("marks > 0")
    w = W.partitionBy("course_id", "t")
    x = per.withColumn("share", F.col("marks") / F.sum("marks").over(w)).join(size, "course_id")
    n = F.col("n_units")
    return x.withColumn("balance", F.when(n > 1, F.sum(-F.col("share") * F.ln("share")).over(w) / F.ln(n)).otherwise(1.0)).drop("n_units")


def topic_coverage(cells: DataFrame) -> DataFrame:
    """course_id, k, rate, tested: never, rarely (up to 0.15), always (from 0.9) or sometimes."""
    r = cells.groupBy("course_id", "k").agg(F.avg("y").alias("rate"))
    return r.withColumn("tested", F.when(F.col("rate") == 0, "never").when(F.col("rate") <= 0.15, "rarely").when(F.col("rate") >= 0.9, "always").otherwise("sometimes"))


def cooccurrence(cells: DataFrame, least: int = 3) -> DataFrame:
    """course_id, j, k, together, lift, p, q: items that meet in an exam more or less than chance, by Fisher's exact test
    with adjusted p values. Courses with fewer than four exams and items in every exam aren't tested."""
    steps = cells.groupBy("course_id").agg(F.count_distinct("t").alias("n")).where("n >= 4")
    seen = cells.where("y > 0").join(steps, "course_id").select("course_id", "t", "k", "n")
    sup = seen.groupBy("course_id", "k").agg(F.count("*").alias("s"), F.first("n").alias("n")).where((F.col("s") >= least) & (F.col("s") < F.col("n")))
    ok = seen.join(sup.select("course_id", "k", "s"), ["course_id", "k"])
    met = ok.select("course_id", "t", F.col("k").alias("j")).join(ok.select("course_id", "t", "k"), ["course_id", "t"]).where("j < k").groupBy("course_id", "j", "k").agg(F.count("*").alias("together"))
    x = met.join(sup.select("course_id", F.col("k").alias("j"), F.col("s").alias("sj"), "n"), ["course_id", "j"]).join(sup.select("course_id", "k", F.col("s").alias("sk")), ["course_id", "k"])

    @F.pandas_udf("double")
    def fisher(a: pd.Series, sj: pd.Series, sk: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([fisher_two_sided(int(p), int(q - p), int(r - p), int(m - q - r + p)) for p, q, r, m in zip(a, sj, sk, n, strict=True)])

    x = x.withColumn("lift", F.col("together") * F.col("n") / (F.col("sj") * F.col("sk"))).withColumn("p", fisher("together", "sj", "sk", "n"))
    return benjamini_hochberg(x, "p", ["j", "k"], "course_id").select("course_id", "j", "k", "together", "lift", "p", "q")


def exam_structure(questions: DataFrame) -> DataFrame:
    """exam_id, questions, slots, parts_median, marks_median, optional: questions of an or-group fill one slot; parts are
    the children of a question."""
    slot = F.coalesce("or_group", F.concat(F.lit("q"), F.col("question_id")))
    parts = questions.where("parent_id is not null").groupBy(F.col("parent_id").alias("question_id")).agg(F.count("*").alias("parts"))
    top = questions.where("parent_id is null").join(parts, "question_id", "left")
    return top.groupBy("exam_id").agg(
        F.count("*").alias("questions"), F.count_distinct(slot).alias("slots"), F.median(F.coalesce("parts", F.lit(0))).alias("parts_median"), F.median("marks").alias("marks_median"),
        F.count(F.when(F.col("is_optional"), 1)).alias("optional"),
    )


def main_marks(questions: DataFrame) -> DataFrame:
    """exam_id, marks: marks of main questions, each or-group once (its first question)."""
    w = W.partitionBy("exam_id", F.coalesce("or_group", F.concat(F.lit("q"), F.col("question_id")))).orderBy("question_id")
    return questions.where("parent_id is null").withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("exam_id").agg(F.sum("marks").alias("marks"))


def usual_structure(structure: DataFrame, exams: DataFrame) -> DataFrame:
    """course_id, slots, share, certainty: the most frequent number of slots in the last five exams, earliest first on ties."""
    x = structure.join(exams.select("exam_id", "course_id", "t"), "exam_id")
    r = x.withColumn("r", F.row_number().over(W.partitionBy("course_id").orderBy(F.desc("t")))).where("r <= 5")
    c = r.groupBy("course_id", "slots").agg(F.count("*").alias("c"), F.min("t").alias("first"))
    c = c.withColumn("n", F.sum("c").over(W.partitionBy("course_id"))).withColumn("b", F.row_number().over(W.partitionBy("course_id").orderBy(F.desc("c"), "first"))).where("b = 1")
    share = F.col("c") / F.col("n")
    return c.select("course_id", "slots", share.alias("share"), F.when((share >= 0.8) & (F.col("n") >= 3), "high").when(share >= 0.6, "usual").otherwise("variable").alias("certainty"))


def format_forecast(obs: DataFrame, half_life: float = 3.0) -> DataFrame:
    """course_id, k, format, p: an item's recency-weighted mix of formats, drawn to the course's mix with strength 2."""
    end = obs.groupBy("course_id").agg(F.max("t").alias("end"))
    x = obs.join(end, "course_id").withColumn("w", F.pow(F.lit(0.5), (F.col("end") - F.col("t")) / half_life))
    glob = end.select("course_id", F.explode(F.array(*[F.lit(f) for f in FORMATS])).alias("format")).join(x.groupBy("course_id", "format").agg(F.sum("w").alias("g")), ["course_id", "format"], "left")
    glob = glob.withColumn("g", (F.coalesce("g", F.lit(0.0)) + 0.5))
    glob = glob.withColumn("g", F.col("g") / F.sum("g").over(W.partitionBy("course_id")))
    items = obs.select("course_id", "k").distinct().join(glob, "course_id").join(x.groupBy("course_id", "k", "format").agg(F.sum("w").alias("i")), ["course_id", "k", "format"], "left")
    i = F.coalesce("i", F.lit(0.0))
    return items.select("course_id", "k", "format", ((i + 2 * F.col("g")) / (F.sum(i).over(W.partitionBy("course_id", "k")) + 2)).alias("p"))


def missing_years(exams: DataFrame) -> DataFrame:
    """course_id, calendar, year: years between the first and last exam of a course in a calendar that have none."""
    y = exams.where("year is not null and calendar is not null").select("course_id", "calendar", "year").distinct()
    span = y.groupBy("course_id", "calendar").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(y, ["course_id", "calendar", "year"], "left_anti")


def timeline(exams: DataFrame) -> DataFrame:
    """course_id, calendar, year, kind, n: exams and missing years in one list; undated exams have null year."""
    have = exams.groupBy("course_id", "calendar", "year").agg(F.count("*").alias("n")).select("course_id", "calendar", "year", F.when(F.col("year").isNull(), "undated").otherwise("exam").alias("kind"), "n")
    return have.unionByName(missing_years(exams).select("course_id", "calendar", "year", F.lit("missing").alias("kind"), F.lit(0).cast("long").alias("n")))


def evidence_profile(cells: DataFrame, exams: DataFrame, obs: DataFrame) -> DataFrame:
    """course_id, exams, undated, effective, years, missing, questions, entropy: what there is to go by."""
    e = exams.groupBy("course_id").agg(F.count("*").alias("exams"), F.count(F.when(F.col("year").isNull(), 1)).alias("undated"), F.count_distinct("year").alias("years"))
    m = missing_years(exams).groupBy("course_id").agg(F.count("*").alias("missing"))
    q = obs.groupBy("course_id").agg(F.count_distinct("question_id").alias("questions"))
    w = W.partitionBy("course_id")
    s = cells.groupBy("course_id", "k").agg(F.sum("y").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(w)).where("p > 0")
    h = s.groupBy("course_id").agg((F.sum(-F.col("p") * F.ln("p")) / F.ln(F.greatest(F.count("*"), F.lit(2)))).alias("entropy"))
    x = e.join(m, "course_id", "left").join(q, "course_id", "left").join(h, "course_id", "left")
    return x.select("course_id", "exams", "undated", (F.col("exams") - 0.5 * F.col("undated")).alias("effective"), "years", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("questions", F.lit(0)).alias("questions"), "entropy")


def supporting_signals(features: DataFrame) -> DataFrame:
    """course_id, k, cutoff, signals, n: which kinds of evidence speak for an item, in a fixed order."""
    f = F.col
    med = F.percentile("sem_ewma", F.lit(0.5)).over(W.partitionBy("course_id", "cutoff"))
    signals = F.filter(
        F.array(F.when(f("freq_all") >= 0.5, "frequency"), F.when(F.round("ewma_short", 9) >= 0.5, "recency"), F.when((f("sem_ewma") >= med) & (f("sem_ewma") > 0), "semantic"), F.when(F.round("marks_share", 9) >= 0.1, "marks")),
        lambda x: x.isNotNull(),
    )
    return features.select("course_id", "k", "cutoff", F.array_join(signals, ", ").alias("signals"), F.size(signals).cast("long").alias("n"))


def evidence_lines(stats: DataFrame) -> DataFrame:
    """course_id, k, line: one sentence on an item's history."""
    plural = lambda c, one: F.concat_ws(" ", F.col(c).cast("string"), F.when(F.col(c) == 1, one).otherwise(one + "s"))
    return stats.select("course_id", "k", F.concat(F.lit("Asked in "), plural("exams", "exam"), F.lit(" with "), plural("questions", "question"), F.lit("; last in exam "), F.col("last_t").cast("string"), F.lit(".")).alias("line"))


def histogram(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, bin, n: equal-width bins between the least and greatest value: as many as distinct values, 3 to 12."""
    s = values.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.least(F.greatest(F.count_distinct(column), F.lit(3)), F.lit(12)).alias("bins"))
    x = values.where(F.col(column).isNotNull()).join(s, list(keys))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)).otherwise(0)
    return x.groupBy(*keys, b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def capped_choice(ranking: DataFrame, units: DataFrame, n: int = 10, cap: int = 3) -> DataFrame:
    """course_id, k, score, pos: the best n items of a course, at most cap of one unit. units: course_id, k, unit."""
    x = ranking.join(units, ["course_id", "k"])
    x = x.withColumn("in_unit", F.row_number().over(W.partitionBy("course_id", "unit").orderBy(F.desc("score"), "k"))).where(F.col("in_unit") <= cap)
    return x.withColumn("pos", F.row_number().over(W.partitionBy("course_id").orderBy(F.desc("score"), "k"))).where(F.col("pos") <= n).select("course_id", "k", "score", "pos")
