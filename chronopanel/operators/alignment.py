"""Questions to the nodes of their course's syllabus: scores, status, one or two topics, and feedback from earlier exams.

Everything is scoped to a course and joined on terms, so the work is that of the pairs that share one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators.review import match_confidence
from chronopanel.sources.tables import cut


@dataclass(frozen=True)
class Rules:
    """Shares of vector and keywords, of a question's own text beside its context; bounds of the status; when a
    second topic counts; the weight of laboratory nodes; feedback. by_backend() gives the bounds of a kind of vectors."""

    vector: float = 0.6
    own: float = 0.7
    clear: float = 0.34
    probable: float = 0.22
    outside: float = 0.12
    coverage_clear: float = 0.30
    unknown_outside: float = 0.60
    second: float = 0.88
    lab: float = 0.6
    feedback: float = 0.35
    least: int = 2
    margin: float = 0.04

    @classmethod
    def by_backend(cls, kind: str) -> Rules:
        return cls(clear=0.62, probable=0.50, outside=0.38) if kind == "neural" else cls()


#: Fixed value: what shows that a question is about laboratory work.
LAB_CUE = r"(?i)\b(?:experiment\w*|apparatus|laborator\w*|lab|procedure|observation\w*|calibrat\w*|verif\w*|practical)\b"


def _unit(x: DataFrame, *keys: str) -> DataFrame:
    """w of length one within keys."""
    return x.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys))))


def scope_idf(nodes: DataFrame, scope: str = "course_id") -> DataFrame:
    """scope, term, idf, df, theory_df (without laboratory nodes), top (idf of a term that no node has). nodes: scope, node_id,
    term, is_lab."""
    n = nodes.groupBy(scope).agg(F.count_distinct("node_id").alias("n"))
    df = nodes.select(scope, "node_id", "term", "is_lab").distinct().groupBy(scope, "term").agg(F.count("*").alias("df"), F.count(F.when(~F.col("is_lab"), 1)).alias("theory_df"))
    return df.join(n, scope).select(scope, "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "df", "theory_df", (F.ln(1 + F.col("n")) + 1).alias("top"))


def status_of(score: Column, sim: Column, coverage: Column, unknown: Column, r: Rules) -> Column:
    """A, B, C or D by score, shared terms and unknown ones."""
    return (
        F.when((score >= r.clear) & ((coverage >= r.coverage_clear) | (sim >= r.clear + 0.15)), "A").when(score < r.outside, "D")
        .when((score < r.probable) & (unknown >= r.unknown_outside), "D").when(score >= r.probable, "B").otherwise("C")
    )


class Aligner:
    """questions: course_id, question_id, t, term, own (how often in the text), around (in text and context together), lab_cue,
    numbers (how many figures with units); a row a distinct term. nodes: course_id, node_id, term, tf, is_lab. ancestors:
    ancestor_id, node_id.

    A question without terms has no row; one of whose terms no node has any has status C or D and no node.
    """

    def __init__(self, questions: DataFrame, nodes: DataFrame, ancestors: DataFrame, rules: Rules = Rules()) -> None:
        self.r, self.ancestors = rules, ancestors
        self.idf = cut(scope_idf(nodes))
        top = self.idf.groupBy("course_id").agg(F.max("top").alias("top"))
        q = questions.join(self.idf.drop("top"), ["course_id", "term"], "left").join(top, "course_id", "left").withColumn("idf", F.coalesce("idf", "top", F.lit(1.0)))
        self.terms = cut(q.select("course_id", "question_id", "t", "term", "own", "around", "lab_cue", "numbers", "idf", F.col("df").isNotNull().alias("known"), F.coalesce("theory_df", F.lit(0)).alias("theory_df")))
        known = self.terms.where("known")
        own = _unit(known.where("own > 0").select("course_id", "question_id", "term", ((1 + F.ln("own")) * F.col("idf")).alias("w")), "question_id")
        around = _unit(known.select("course_id", "question_id", "term", ((1 + F.ln("around")) * F.col("idf")).alias("w")), "question_id")
        both = own.withColumn("w", rules.own * F.col("w")).unionByName(around.withColumn("w", (1 - rules.own) * F.col("w")))
        self.vectors = cut(_unit(both.groupBy("course_id", "question_id", "term").agg(F.sum("w").alias("w")), "question_id"))
        n = nodes.join(self.idf.select("course_id", "term", "idf"), ["course_id", "term"])
        self.nodes = cut(_unit(n.select("course_id", "node_id", "term", "is_lab", ((1 + F.ln("tf")) * F.col("idf")).alias("w")), "course_id", "node_id"))
        figures = F.max("numbers") >= 2
        unknown = F.count(F.when(~F.col("known"), 1))
        ratio = F.sum(F.when(~F.col("known"), F.col("idf")).otherwise(0.0)) / F.sum("idf")
        ratio = F.when(figures & (unknown < 2), F.least(ratio, F.lit(rules.unknown_outside - 0.01))).otherwise(ratio)
        self.facts = cut(self.terms.groupBy("course_id", "question_id").agg(
            F.first("t").alias("t"), F.sum("idf").alias("total"), ratio.alias("unknown"), (F.max(F.col("theory_df").between(1, 2).cast("int")) > 0).alias("distinctive"), F.max(F.col("lab_cue").cast("int")).alias("lab_cue"),
        ))

    def scored(self, nodes: DataFrame, at: list[str]) -> DataFrame:
        """course_id, question_id, node_id, score, sim, coverage of all pairs that share a term. nodes: course_id, node_id, term,
        is_lab, w, and t if at names it."""
        q = self.vectors.join(self.facts.select("question_id", "t"), "question_id") if at else self.vectors
        pairs = q.join(nodes.withColumnRenamed("w", "wn"), ["course_id", "term", *at]).join(self.idf.select("course_id", "term", "idf"), ["course_id", "term"])
        x = pairs.groupBy("course_id", "question_id", "node_id").agg(F.sum(F.col("w") * F.col("wn")).alias("sim"), F.sum("idf").alias("had"), F.max("is_lab").alias("is_lab"))
        x = x.join(self.facts, ["course_id", "question_id"]).withColumn("coverage", F.col("had") / F.col("total"))
        score = self.r.vector * F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0)) + (1 - self.r.vector) * F.col("coverage")
        score = F.when(F.col("is_lab") & (F.col("lab_cue") == 0), score * self.r.lab).otherwise(score)
        return x.select("course_id", "question_id", "t", "node_id", F.round(score, 9).alias("score"), "sim", "coverage", "unknown", "distinctive")

    def matched(self, scored: DataFrame) -> DataFrame:
        """course_id, question_id, t, node_id, rank, score, sim, coverage, status, confidence: the best node, and a second one
        that is nearly as good and neither above nor below it; questions that share no term have null node_id."""
        r = self.r
        place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "node_id"))
        near = scored.withColumn("place", place).where(F.col("place") <= 8)
        best = near.where("place = 1").select("question_id", F.col("node_id").alias("b_node"), F.col("score").alias("b_score"))
        second = near.where("place > 1").join(best, "question_id").where((F.col("score") >= r.second * F.col("b_score")) & (F.col("score") >= r.probable))
        up = self.ancestors.select(F.col("ancestor_id").alias("_a"), F.col("node_id").alias("_n"))
        for a, b in (("node_id", "b_node"), ("b_node", "node_id")):
            second = second.join(up, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_n")), "left_anti")
        second = second.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("place"))).where("place = 1").withColumn("rank", F.lit(2)).drop("b_node", "b_score", "place")
        both = near.where("place = 1").drop("place").withColumn("rank", F.lit(1)).unionByName(second)
        doubt = F.when((F.col("rank") == 1) & F.col("distinctive"), 0.0).otherwise(F.col("unknown"))
        both = both.select("course_id", "question_id", "t", "node_id", "rank", "score", "sim", "coverage", status_of(F.col("score"), F.col("sim"), F.col("coverage"), doubt, r).alias("status"), match_confidence(F.col("score"), r.clear, r.probable, r.outside).alias("confidence"))
        rest = self.facts.join(scored.select("question_id").distinct(), "question_id", "left_anti")
        return both.unionByName(rest.select("course_id", "question_id", "t", F.lit(None).cast("long").alias("node_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("score"), F.lit(0.0).alias("sim"), F.lit(0.0).alias("coverage"), F.lit("D").alias("status"), F.lit(0.0).alias("confidence")))

    def confident(self, scored: DataFrame) -> DataFrame:
        """course_id, question_id, t, node_id of the matches that may teach a node: status A, clearly before the next."""
        w = W.partitionBy("question_id").orderBy(F.desc("score"), "node_id")
        x = scored.withColumn("place", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("place = 1")
        status = status_of(F.col("score"), F.col("sim"), F.col("coverage"), F.when(F.col("distinctive"), 0.0).otherwise(F.col("unknown")), self.r)
        return x.where((status == "A") & (F.col("score") - F.col("next") >= self.r.margin)).select("course_id", "question_id", "t", "node_id")

    def taught(self, confident: DataFrame) -> DataFrame:
        """course_id, t, node_id, term, is_lab, w: the nodes as they stand at each exam t, moved towards the confident questions
        of earlier exams alone (at least Rules.least of them).

        A node changes after each exam that teaches it; an exam takes the last state before it."""
        per = confident.groupBy("course_id", "node_id", "t").agg(F.count("*").alias("n"))
        w = W.partitionBy("course_id", "node_id").orderBy("t")
        change = per.select("course_id", "node_id", F.col("t").alias("since"), F.sum("n").over(w).alias("n"))
        said = confident.join(self.vectors, ["course_id", "question_id"]).groupBy("course_id", "node_id", "t", "term").agg(F.sum("w").alias("w"))
        state = change.where(F.col("n") >= self.r.least).join(said, ["course_id", "node_id"]).where("t <= since").groupBy("course_id", "node_id", "since", "term", "n").agg(F.sum("w").alias("s"))
        moved = state.select("course_id", "node_id", "since", "term", (self.r.feedback * F.col("s") / F.col("n")).alias("w"))
        base = change.where(F.col("n") >= self.r.least).select("course_id", "node_id", "since").join(self.nodes, ["course_id", "node_id"])
        lab = self.nodes.groupBy("course_id", "node_id").agg(F.max("is_lab").alias("is_lab"))
        new = base.select("course_id", "node_id", "since", "term", "w").unionByName(moved).groupBy("course_id", "node_id", "since", "term").agg(F.sum("w").alias("w")).join(lab, ["course_id", "node_id"])
        new = _unit(new, "course_id", "node_id", "since")
        steps = self.facts.select("course_id", "t").distinct()
        valid = steps.join(change.where(F.col("n") >= self.r.least).select("course_id", "node_id", "since"), "course_id").where("since < t").groupBy("course_id", "t", "node_id").agg(F.max("since").alias("since"))
        learnt = valid.join(new, ["course_id", "node_id", "since"]).select("course_id", "t", "node_id", "term", "is_lab", "w")
        plain = steps.join(self.nodes.select("course_id", "node_id").distinct(), "course_id").join(valid, ["course_id", "t", "node_id"], "left_anti").join(self.nodes, ["course_id", "node_id"])
        return learnt.unionByName(plain.select("course_id", "t", "node_id", "term", "is_lab", "w"))

    def run(self, feedback: bool = True) -> DataFrame:
        """matched() of all questions; with feedback, each exam's by nodes taught by the exams before it."""
        first = self.scored(self.nodes, [])
        if not feedback:
            return self.matched(first)
        return self.matched(self.scored(self.taught(self.confident(cut(first))), ["t"]))
