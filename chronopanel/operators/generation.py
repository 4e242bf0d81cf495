"""Merging of syllabuses, templates of past questions, and invented papers."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators.recurrence import indel_ratio, token_set_ratio


@functools.lru_cache(20_000)
def _words(title: str) -> tuple[str, ...]:
    return tuple(re.findall(r"\w+", title.lower()))


def may_reach(a: str, b: str, least: float) -> bool:
    """False only where title_score(a, b) is below least: without a common word, both ratios are bounded by the lengths."""
    x, y = _words(a), _words(b)
    if not x or not y or not set(x).isdisjoint(y):
        return bool(x and y)
    m, n = sum(map(len, x)) + len(x) - 1, sum(map(len, y)) + len(y) - 1
    return 200.0 * min(m, n) / (m + n) + 6 >= least


def title_score(a: str, b: str) -> float:
    """0 to 100: the better of token-set and plain ratio; a single word can't gain more than 10 by its set; the same number
    in both adds 6; a title without words is like no other."""
    x, y = (" ".join(_words(t)) for t in (a, b))
    if not x or not y:
        return 0.0
    plain = indel_ratio(x, y)
    best = max(token_set_ratio(x, y), plain)
    if min(len(x.split()), len(y.split())) <= 1:
        best = min(best, plain + 10)
    same = set(re.findall(r"\d+", a)) & set(re.findall(r"\d+", b))
    return min(100.0, best + 6 * bool(same))


def merge_titles(new: DataFrame, base: DataFrame, scope: str = "course_id", near: float = 86.0, anywhere: float = 90.0) -> DataFrame:
    """node_id, match, score: for each new node the base node that it is, in its parent's scope first, then anywhere in the
    course; null match is to be appended. new, base: scope, node_id, parent_title, title. All pairs of a scope count; only
    those whose lengths keep the score below both thresholds aren't scored."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([title_score(x, y) if may_reach(x, y, least) else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")

    least = min(near, anywhere)
    n = new.where("title is not null").select(scope, "node_id", "parent_title", "title")
    b = base.where("title is not null").select(scope, F.col("node_id").alias("match"), F.col("parent_title").alias("b_parent"), F.col("title").alias("b_title"))
    pairs = n.join(b, scope).withColumn("score", score("title", "b_title"))
    local = F.col("parent_title").eqNullSafe(F.col("b_parent"))
    ok = pairs.where((local & (F.col("score") >= near)) | (F.col("score") >= anywhere))
    best = ok.groupBy("node_id").agg(F.max_by(F.struct("match", "score"), F.struct(local & (F.col("score") >= near), "score", -F.col("match"))).alias("m"))
    return new.select("node_id").distinct().join(best, "node_id", "left").select("node_id", "m.match", "m.score")


def numeric_template(text: Column) -> Column:
    """A question with its values replaced by [value in unit] or [value]."""
    unit = r"(kPa|kHz|kN|kJ|kW|kg|Hz|ohm|bar|rpm|litres|min|mol|mm|cm|kV|Pa|N|J|W|V|A|K|m|s)"
    x = F.regexp_replace(text, rf"\b\d+(?:\.\d+)?\s*{unit}\b", "[value in $1]")
    return F.regexp_replace(x, r"\b\d+(?:\.\d+)?\b", "[value]")


def proper_nouns(text: Column) -> Column:
    """Capitalised words inside sentences, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-z,;] ([A-Z][a-z]{2,})\b"), F.lit(1)))


def item_formats(obs: DataFrame) -> DataFrame:
    """course_id, k, format, basis: the format to expect of an item: its own by exams (history, from two exams on; weak
    before), ties by questions and name."""
    per = obs.groupBy("course_id", "k", "format").agg(F.count_distinct("t").alias("exams"), F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("course_id", "k").orderBy(F.desc("exams"), F.desc("n"), "format"))
    return per.withColumn("r", r).where("r = 1").select("course_id", "k", "format", F.when(F.col("exams") >= 2, "history").otherwise("weak").alias("basis"))


def representatives(obs: DataFrame, texts: DataFrame) -> DataFrame:
    """course_id, k, question_id, template: the past question that stands for an item: of the last exam with its main
    format, the best scored."""
    f = item_formats(obs).select("course_id", "k", "format")
    x = obs.join(f, ["course_id", "k", "format"])
    r = F.row_number().over(W.partitionBy("course_id", "k").orderBy(F.desc("t"), F.desc("score"), "question_id"))
    return x.withColumn("r", r).where("r = 1").select("course_id", "k", "question_id").join(texts, "question_id", "left").select("course_id", "k", "question_id", numeric_template(F.col("text")).alias("template"))


def invented_papers(ranking: DataFrame, units: DataFrame, papers: int = 3, n: int = 10, cap: int = 3, noise: float = 0.1, seed: int = 7) -> DataFrame:
    """course_id, paper, pos, k: papers of n items, at most cap of a unit; paper 1 takes the best, the others by scores
    with Gumbel noise, the same for the same seed."""
    x = ranking.join(units, ["course_id", "k"]).select("course_id", "k", "score", "unit", F.explode(F.sequence(F.lit(1), F.lit(papers))).alias("paper"))
    u = (F.pmod(F.xxhash64("course_id", "k", "paper", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    x = x.withColumn("s", F.col("score") + F.when(F.col("paper") > 1, -noise * F.ln(-F.ln(u))).otherwise(0.0))
    key = ["course_id", "paper"]
    x = x.withColumn("in_unit", F.row_number().over(W.partitionBy(*key, "unit").orderBy(F.desc("s"), "k"))).where(F.col("in_unit") <= cap)
    return x.withColumn("pos", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("s"), "k"))).where(F.col("pos") <= n).select("course_id", "paper", "pos", "k")
