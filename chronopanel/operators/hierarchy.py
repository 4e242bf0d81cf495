"""Parent-child rows to full hierarchies: paths, depths, roots, nested-set ranges, and the nodes without one.

Subtree sizes are summed upward, preorder ranges are allocated to siblings by prefix sums and carried downward, and
ancestors and descendants are read off the ranges. Both directions run by pointer doubling, so a tree of depth d takes
about log2(d) rounds, each one join and one aggregation over all nodes. Nodes that no round reaches from a root are on a
cycle or below one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.sources.tables import cut, drop_cut

#: Sibling groups are summed in so many slices of the id range, so that a parent of a third of all nodes isn't one task.
SLICES = 256


def latest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row a key: the one with the greatest `at` (null first), ties by the greatest remaining values. Null keys go."""
    newest = F.max(F.struct(F.col(at), *columns)).alias("_row")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


class _Rounds:
    """Counts rounds of pointer doubling and says when the rest can't reach a root.

    A round that frees no node means that all the rest hang on cycles. To end on the cycle, every pointer must have
    jumped at least as far as the rest is long."""

    def __init__(self, stuck: int) -> None:
        self.stuck, self.left, self.extra, self.done = stuck, None, 0, 0

    def more(self) -> bool:
        return bool(self.stuck and (self.stuck != self.left or self.extra))

    def ran(self, stuck: int) -> None:
        self.done += 1
        self.left, self.stuck = self.stuck, stuck
        self.extra = max(0, (stuck - 1).bit_length() + 1 - self.done) if stuck == self.left else 0


def _subtrees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From nodes (id, up): id, size of the subtrees of more than one node, and id, up of the nodes that reach no root;
    that up is on a cycle.

    Only nodes that haven't reached a root stay in the loop; what they report to those above is written once a round and
    summed at the end. A parent of very many nodes is a hot key of the left side alone, which adaptive execution splits.
    """
    rest = cut(nodes.where(F.col("up").isNotNull()).select("id", "up", F.lit(1).cast("long").alias("size")))
    rounds, reports = _Rounds(rest.count()), []
    while rounds.more():
        below = cut(rest.groupBy(F.col("up").alias("b_id")).agg(F.sum("size").alias("b_size")))
        reports.append(below)
        u = rest.select(F.col("id").alias("u_id"), F.col("up").alias("u_up"))
        # A node whose target isn't among the rest has arrived.
        on = rest.join(u, rest["up"] == u["u_id"]).where("u_up is not null").join(below, F.col("id") == F.col("b_id"), "left")
        after = cut(on.select("id", F.col("u_up").alias("up"), (F.col("size") + F.coalesce("b_size", F.lit(0))).alias("size")))
        drop_cut(rest)
        rest = after
        rounds.ran(rest.count())
    sums = rest.where("false").select("id", "size")
    for part in reports:
        sums = sums.unionByName(part.select(F.col("b_id").alias("id"), F.col("b_size").alias("size")))
    out = cut(sums.groupBy("id").agg((F.sum("size") + 1).alias("size")))
    for part in reports:
        drop_cut(part)
    return out, rest.select("id", "up")


def carried(nodes: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """nodes (id, up and the columns of carry) with those columns combined along the chain up to the root.

    carry: how a column of a node and the same of the node that it points to (u_...) combine. Nodes that reach a root are
    appended to the result and leave the loop; nodes that never reach one have no row.
    """
    now = cut(nodes)
    kept, done = [now], [now.where(F.col("up").isNull()).select("id", *carry)]
    rest = now.where(F.col("up").isNotNull()).select("id", "up", *carry)
    rounds = _Rounds(rest.count())
    while rounds.more():
        u = rest.select(F.col("id").alias("u_id"), F.col("up").alias("u_up"), *[F.col(c).alias(f"u_{c}") for c in carry])
        for part in done:
            u = u.unionByName(part.select(F.col("id").alias("u_id"), F.lit(None).cast("long").alias("u_up"), *[F.col(c).alias(f"u_{c}") for c in carry]))
        after = cut(rest.join(u, rest["up"] == u["u_id"]).select("id", F.col("u_up").alias("up"), *[how.alias(c) for c, how in carry.items()]))
        kept.append(after)
        done.append(after.where(F.col("up").isNull()).select("id", *carry))
        rest = after.where(F.col("up").isNotNull())
        rounds.ran(rest.count())
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    whole = cut(out)
    for part in kept:
        drop_cut(part)
    return whole


def roots(rows: DataFrame, node: str = "node_id", parent: str = "parent_id", at: str = "loaded_at") -> DataFrame:
    """node, root_id: the root above each node (itself for a root and an orphan); a node on or below a cycle is its own."""
    base = latest(rows, node, at, [parent]).select(F.col(node).cast("long").alias("id"), F.col(parent).cast("long").alias("parent"))
    known = base.select(F.col("id").alias("k_id"))
    start = base.join(known, base["parent"] == known["k_id"], "left").select("id", F.col("k_id").alias("up"), F.col("id").alias("root"))
    start = cut(start)
    top = carried(start, {"root": F.col("u_root")}).select(F.col("id").alias("r_id"), F.col("root").alias("r"))
    return start.join(top, F.col("id") == F.col("r_id"), "left").select(F.col("id").alias(node), F.coalesce("r", "id").alias("root_id"))


def hierarchy(rows: DataFrame, node: str = "node_id", parent: str = "parent_id", title: str = "title", depth: str = "depth", at: str = "loaded_at", sep: str = " > ", paths: bool = True) -> DataFrame:
    """One row a node: parent_id, title, stored_depth, path (titles from the root), depth, root_id, lft, rgt, n_descendants, issue.

    - Of several rows of a node the latest counts; rows with a null node are dropped; other columns don't matter.
    - A node whose parent isn't in the table is an `orphan` and the root of its own tree.
    - Nodes on a cycle get issue `cycle`, nodes below one `no_root`; their path, depth, root_id, lft and rgt are null.
    - issue `depth`: the chain ends at a node with null parent and a stored depth that isn't null differs (a root has 1).
      An orphan keeps its issue `orphan`. Otherwise issue is null. A null title stands as an empty step of the path.
    - lft and rgt number the nodes of a tree in preorder from 1, siblings by node id; the descendants of a node are the
      nodes of the same root_id with lft in (lft, rgt]. An empty table gives no rows.
    - Without paths, path is left out: it is the one figure whose size grows with the depth.
    """
    base = latest(rows, node, at, [parent, depth, title]).select(
        F.col(node).cast("long").alias("id"), F.col(parent).cast("long").alias("parent"), F.col(depth).cast("int").alias("stored_depth"), F.col(title).alias("title")
    )
    base = cut(base)
    known = base.select(F.col("id").alias("k_id"))
    start = base.join(known, base["parent"] == known["k_id"], "left").select(
        "id", "parent", "stored_depth", "title", F.col("k_id").alias("up"), (F.col("parent").isNotNull() & F.col("k_id").isNull()).alias("orphan")
    )
    start = cut(start)
    drop_cut(base)
    # Upward: the size of each subtree; what never points past a root hangs on a cycle.
    sized, looped = _subtrees(start.select("id", "up"))
    sized = sized.select(F.col("id").alias("s_id"), "size")
    off = looped.select(F.col("id").alias("l_id"))
    on_cycle = looped.select(F.col("up").alias("c_id")).distinct()
    # Siblings in order of id: the range of a child starts after the earlier siblings' subtrees.
    bounds = start.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    lo, width = bounds["lo"] or 0, max(1, ((bounds["hi"] or 0) - (bounds["lo"] or 0)) // SLICES + 1)
    tree = start.join(off, F.col("id") == F.col("l_id"), "left_anti").join(sized, F.col("id") == F.col("s_id"), "left").drop("s_id").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    tree = tree.withColumn("slice", F.floor((F.col("id") - F.lit(lo)) / F.lit(width)).cast("long"))
    children = tree.where(F.col("up").isNotNull())
    inside = children.select("id", "up", "slice", (F.sum("size").over(W.partitionBy("up", "slice").orderBy("id").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    slices = children.groupBy(F.col("up").alias("p_up"), F.col("slice").alias("p_slice")).agg(F.sum("size").alias("total"))
    slices = slices.select("p_up", "p_slice", F.sum("total").over(W.partitionBy("p_up").orderBy("p_slice").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    offset = inside.join(slices, (F.col("up") == F.col("p_up")) & (F.col("slice") == F.col("p_slice"))).select(
        F.col("id").alias("o_id"), (F.lit(1) + F.coalesce("before", F.lit(0)) + F.coalesce("earlier", F.lit(0))).cast("long").alias("step")
    )
    carry = {"lft": F.col("lft") + F.col("u_lft"), "depth": F.col("depth") + F.col("u_depth"), "root": F.col("u_root"), "root_orphan": F.col("u_root_orphan"), "size": F.col("size")}
    if paths:
        carry["path"] = F.concat_ws(sep, "u_path", "path")
    placed = tree.join(offset, F.col("id") == F.col("o_id"), "left").select(
        "id", "up", F.coalesce("step", F.lit(1)).cast("long").alias("lft"), F.lit(1).cast("int").alias("depth"), F.col("id").alias("root"), F.col("orphan").alias("root_orphan"), "size",
        *([F.coalesce("title", F.lit("")).alias("path")] if paths else []),
    )
    # Downward: offsets, depths and titles are summed along the chain of parents.
    facts = carried(placed, carry).withColumnRenamed("id", "r_id")
    out = start.join(facts, F.col("id") == F.col("r_id"), "left").join(on_cycle, F.col("id") == F.col("c_id"), "left")
    issue = (
        F.when(F.col("c_id").isNotNull(), "cycle").when(F.col("r_id").isNull(), "no_root").when(F.col("orphan"), "orphan")
        .when(~F.col("root_orphan") & F.col("stored_depth").isNotNull() & (F.col("stored_depth") != F.col("depth")), "depth")
    )
    return out.select(
        F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "title", "stored_depth", *(["path"] if paths else []), "depth", F.col("root").alias("root_id"), "lft",
        (F.col("lft") + F.col("size") - 1).alias("rgt"), F.when(F.col("lft").isNotNull(), F.col("size") - 1).alias("n_descendants"), issue.alias("issue"),
    )


def descendant_pairs(nested: DataFrame) -> DataFrame:
    """ancestor_id, node_id, distance: every node below every node, by the ranges of hierarchy().

    A range is cut into aligned blocks of powers of two, at most two a power; a node lies in one block a power, so an
    equi-join on (root, power, block) finds each pair exactly once, without a range join and without one task a tree.
    Nodes without a range have no pairs.
    """
    n = nested.where(F.col("lft").isNotNull()).select("node_id", "root_id", "lft", "rgt", "depth")
    top = n.agg(F.max("rgt")).first()[0] or 1
    powers = range(int(top).bit_length() + 1)
    a, b = F.col("lft") + 1, F.col("rgt") + 1  # [a, b): what lies strictly below
    up = lambda x, p: F.ceil(x / F.lit(1 << p)).cast("long")
    down = lambda x, p: F.floor(x / F.lit(1 << p)).cast("long")

    def blocks(p: int) -> Column:
        """Blocks of power p inside [a, b) that aren't inside a block of power p + 1 that is inside, too."""
        first, last = up(a, p), down(b, p)  # blocks first..last-1 lie inside
        f2, l2 = up(a, p + 1) * 2, down(b, p + 1) * 2  # the part of them that larger blocks take
        mine = F.when(f2 >= l2, F.when(last > first, F.sequence(first, last - 1))).otherwise(
            F.concat(F.when(f2 > first, F.sequence(first, f2 - 1)).otherwise(F.array().cast("array<long>")), F.when(last > l2, F.sequence(l2, last - 1)).otherwise(F.array().cast("array<long>")))
        )
        return F.transform(F.coalesce(mine, F.array().cast("array<long>")), lambda x: F.struct(F.lit(p).alias("p"), x.alias("b")))

    over = n.where("rgt > lft").select("node_id", "root_id", "depth", F.explode(F.flatten(F.array(*[blocks(p) for p in powers]))).alias("k"))
    over = over.select(F.col("node_id").alias("ancestor_id"), F.col("root_id").alias("a_root"), F.col("depth").alias("a_depth"), F.col("k.p").alias("a_p"), F.col("k.b").alias("a_b"))
    under = n.where("lft > 1").select("node_id", "root_id", "depth", F.posexplode(F.array(*[down(F.col("lft"), p) for p in powers])).alias("p", "b"))
    on = (F.col("root_id") == F.col("a_root")) & (F.col("p") == F.col("a_p")) & (F.col("b") == F.col("a_b"))
    return under.join(over, on).select("ancestor_id", "node_id", (F.col("depth") - F.col("a_depth")).cast("int").alias("distance"))


def hierarchy_issues(nested: DataFrame) -> DataFrame:
    """node_id, issue of the nodes that have one."""
    return nested.where(F.col("issue").isNotNull()).select("node_id", "issue")
