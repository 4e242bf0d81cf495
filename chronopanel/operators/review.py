"""Corrections laid over the stored rows, fingerprints, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlay(rows: DataFrame, edits: DataFrame, key: str, columns: list[str], seq: str = "seq") -> DataFrame:
    """rows with the last edit of each key laid over: a column that the edit leaves null keeps its value; an edit marked
    deleted takes the row out. edited says whether a row was changed."""
    last = edits.groupBy(key).agg(F.max_by(F.struct(*columns, "deleted"), seq).alias("_e")).select(F.col(key).alias("_k"), "_e")
    x = rows.join(last, rows[key] == F.col("_k"), "left").where(~F.coalesce(F.col("_e.deleted"), F.lit(False)))
    other = [c for c in rows.columns if c not in columns]
    return x.select(*[rows[c] for c in other], *[F.coalesce(F.col(f"_e.{c}"), rows[c]).alias(c) for c in columns], F.col("_k").isNotNull().cast("int").alias("edited"))


def merged_with_next(questions: DataFrame, order: str = "question_id") -> DataFrame:
    """exam_id, question_id, text, marks: each question joined with the next one of its exam; marks are summed."""
    w = W.partitionBy("exam_id").orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    return questions.select("exam_id", "question_id", F.concat_ws(" ", "text", nxt("text")).alias("text"), (F.col("marks") + nxt("marks")).alias("marks")).where(F.col("marks").isNotNull())


def split_at_sentences(questions: DataFrame) -> DataFrame:
    """question_id, part, text: a question split after each full stop, parts renumbered from 1."""
    parts = F.filter(F.split(F.col("text"), r"\. "), lambda p: F.trim(p) != "")
    return questions.select("question_id", F.posexplode(parts).alias("pos", "text")).select("question_id", (F.col("pos") + 1).alias("part"), F.trim("text").alias("text"))


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def fingerprint(rows: DataFrame, part: Column, *columns: str) -> DataFrame:
    """part, rows, h1, h2: order-free hash of the rows of each part, combined before the shuffle; equal rows count."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    # Sums of 48-bit pieces don't depend on the order of rows.
    piece = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.sum(piece(1)).cast("string").alias("h1"), F.sum(piece(13)).cast("string").alias("h2"))


def changed_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """part, change (added, removed, changed) between two fingerprints."""
    o, n = old.select("part", F.struct("rows", "h1", "h2").alias("o")), new.select("part", F.struct("rows", "h1", "h2").alias("n"))
    x = o.join(n, "part", "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return x.select("part", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))


def mapping_status(score: Column, clear: float = 0.34, probable: float = 0.22, outside: float = 0.12) -> Column:
    """A, B, C or D by score alone."""
    return F.when(score >= clear, "A").when(score < outside, "D").when(score >= probable, "B").otherwise("C")


def match_confidence(score: Column, clear: float = 0.34, probable: float = 0.22, outside: float = 0.12) -> Column:
    """Piecewise linear: 0.25 at outside, 0.5 at probable, 0.75 at clear, and 1 from 0.3 above it; null without a score."""
    up = lambda a, b, x, y: x + (score - a) / (b - a) * (y - x)
    s = F.when(score <= outside, F.greatest(F.lit(0.0), up(0.0, outside, 0.0, 0.25))).when(score <= probable, up(outside, probable, 0.25, 0.5)).when(score <= clear, up(probable, clear, 0.5, 0.75)).otherwise(0.75 + 0.25 * (score - clear) / 0.3)
    return F.when(score.isNotNull(), F.least(s, F.lit(1.0)))


def counts_for_prediction(status: Column, method: Column, score: Column, strictness: float = 0.5, clear: float = 0.34, probable: float = 0.22) -> Column:
    """Whether a mapping counts: a manual one of A or B and no other manual one; else A always, B above a bound that rises
    with strictness, C if that is low."""
    bound = probable + (clear - probable) * max(0.0, strictness - 0.5) * 2
    return (
        F.when(method == "manual", F.coalesce(status.isin("A", "B"), F.lit(False))).when(status == "A", True).when(status == "B", (score >= bound) & F.lit(strictness < 1))
        .when(status == "C", F.lit(strictness <= 0.25)).otherwise(False)
    )
