"""Syllabus trees: levels, roll-ups, inherited exclusion, context texts; edits that keep them trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.hierarchy import carried, descendant_pairs, latest, roots
from chronopanel.sources.tables import cut, drop_cut


def roles(nested: DataFrame, facts: DataFrame) -> DataFrame:
    """node_id, depth, role, unit_id, topic_id, is_leaf, excluded of nodes that hang on a root.

    A unit has depth 1; a topic depth 2, or depth 1 without children; a concept is any leaf below a topic. unit_id is the
    root, topic_id the ancestor at topic level (the node itself there). Exclusion is inherited from any ancestor.
    """
    n = nested.where("lft is not null").select("node_id", "depth", "root_id", (F.col("rgt") == F.col("lft")).alias("is_leaf"), F.when(F.col("depth") > 1, F.col("parent_id")).alias("up"))
    flag = facts.select(F.col("node_id").alias("a"), F.coalesce("excluded", F.lit(False)).cast("int").alias("x"))
    start = n.join(flag, F.col("node_id") == F.col("a"), "left").select(F.col("node_id").alias("id"), "up", F.coalesce("x", F.lit(0)).alias("x"), F.when(F.col("depth") == 2, F.col("node_id")).alias("t2"))
    # Exclusion and the topic come down the chain of parents.
    down = carried(start, {"x": F.greatest("x", "u_x"), "t2": F.coalesce("t2", "u_t2")})
    x = n.join(down, F.col("node_id") == F.col("id"))
    topic = F.when(F.col("depth") == 2, F.col("node_id")).when((F.col("depth") == 1) & F.col("is_leaf"), F.col("node_id")).otherwise(F.col("t2"))
    role = F.when((F.col("depth") == 2) | ((F.col("depth") == 1) & F.col("is_leaf")), "topic").when(F.col("depth") == 1, "unit").when(F.col("is_leaf"), "concept").otherwise("group")
    return x.select("node_id", "depth", role.alias("role"), F.col("root_id").alias("unit_id"), topic.alias("topic_id"), F.col("is_leaf").cast("int").alias("is_leaf"), F.col("x").alias("excluded"))


def item_nodes(mappings: DataFrame, obs: DataFrame) -> DataFrame:
    """course_id, k, node_id: the node that stands for an item: the least of those it is mapped to."""
    m = mappings.select("question_id", "k", "node_id").distinct()
    return obs.select("course_id", "k", "question_id").join(m, ["question_id", "k"]).groupBy("course_id", "k").agg(F.min("node_id").alias("node_id"))


def item_units(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """course_id, k, unit: the syllabus unit of an item, the root above its node; an item whose node isn't in rows is a
    unit by itself, named by the node. nodes: course_id, k, node_id; rows: the rows of the tree."""
    top = roots(rows).select(F.col("node_id").alias("_n"), "root_id")
    return nodes.join(top, F.col("node_id") == F.col("_n"), "left").select("course_id", "k", F.coalesce("root_id", "node_id").alias("unit"))


def node_documents(facts: DataFrame) -> DataFrame:
    """node_id, document: the text that stands for a node: its title twice, its concepts, its parent's title."""
    p = facts.select(F.col("node_id").alias("p_id"), F.col("title").alias("p_title"))
    x = facts.join(p, F.col("parent_id") == F.col("p_id"), "left")
    return x.select("node_id", F.concat_ws(" ", "title", "title", F.array_join("concepts", " "), "p_title").alias("document"))


def context_texts(questions: DataFrame, words: int = 60) -> DataFrame:
    """question_id, context: the stems of all questions above, outermost first, at most so many words of each, before the
    question's own text. A question on or below a cycle of parents, or whose parent isn't there, has its own text alone."""
    short = lambda c: F.array_join(F.slice(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), 1, words), " ")
    known = questions.select(F.col("question_id").alias("_p"))
    q = questions.join(known, F.col("parent_id") == F.col("_p"), "left")
    start = q.select(F.col("question_id").alias("id"), F.col("_p").alias("up"), F.lit(None).cast("string").alias("above"), short(F.col("text")).alias("stem"))
    # above: the stems from the top down to the question that points to the node's target; stem: that of the node itself.
    joined = lambda *c: F.nullif(F.concat_ws(" ", *c), F.lit(""))
    stems = start.select("id", "stem")
    start = start.where("up is not null").join(stems.select(F.col("id").alias("_s"), F.col("stem").alias("_stem")), F.col("up") == F.col("_s")).select("id", "up", F.col("_stem").alias("above")).unionByName(start.where("up is null").select("id", "up", "above"))
    chains = carried(start, {"above": joined("u_above", "above")}).select(F.col("id").alias("_c"), "above")
    return questions.join(chains, F.col("question_id") == F.col("_c"), "left").select("question_id", F.concat_ws(" ", "above", F.trim("text")).alias("context"))


def kind_prior(nested: DataFrame, facts: DataFrame) -> DataFrame:
    """node_id, kind: the kinds that a node or anything below it is tagged with."""
    own = facts.select("node_id", F.explode("kinds").alias("kind"))
    below = descendant_pairs(nested).join(own, "node_id").select(F.col("ancestor_id").alias("node_id"), "kind")
    return own.unionByName(below).distinct()


def kinds_below(facts: DataFrame) -> DataFrame:
    """node_id, kind: the kinds that a node or anything below it is tagged with, carried up the chains of parents; a node on
    or below a cycle has those of the nodes that lead to it.

    In a round every (node, kind) also counts for the node that it points to, and pointers double, so that a tree of depth d
    takes log2(d) rounds over distinct pairs, without all pairs of ancestors and descendants."""
    up = facts.where("parent_id is not null").join(facts.select(F.col("node_id").alias("_p")), F.col("parent_id") == F.col("_p"), "left_semi").select(F.col("node_id").alias("id"), F.col("parent_id").alias("up"))
    up, pairs = cut(up), cut(facts.select(F.col("node_id").alias("id"), F.explode("kinds").alias("kind")).distinct())
    size = pairs.count()
    while up.limit(1).count():
        raised = pairs.join(up, "id").select(F.col("up").alias("id"), "kind")
        now = cut(pairs.unionByName(raised).distinct())
        nxt = cut(up.join(up.select(F.col("id").alias("_i"), F.col("up").alias("_u")), F.col("up") == F.col("_i")).select("id", F.col("_u").alias("up")))
        drop_cut(pairs)
        drop_cut(up)
        pairs, up, before, size = now, nxt, size, now.count()
        if size == before:  # nothing rose: nothing will
            break
    return pairs.select(F.col("id").alias("node_id"), "kind")


def rejected_moves(nested: DataFrame, moves: DataFrame) -> DataFrame:
    """node_id, new_parent_id, reason of moves (node_id, new_parent_id) that would make a cycle or lead nowhere."""
    n = nested.select("node_id", "root_id", "lft", "rgt")
    p = n.select(F.col("node_id").alias("p_id"), F.col("root_id").alias("p_root"), F.col("lft").alias("p_lft"))
    x = moves.join(n, "node_id", "left").join(p, F.col("new_parent_id") == F.col("p_id"), "left")
    inside = (F.col("root_id") == F.col("p_root")) & F.col("p_lft").between(F.col("lft"), F.col("rgt"))
    reason = F.when(F.col("new_parent_id").isNotNull() & F.col("p_id").isNull(), "no such parent").when(inside | (F.col("node_id") == F.col("new_parent_id")), "cycle")
    return x.select("node_id", "new_parent_id", reason.alias("reason")).where("reason is not null")
