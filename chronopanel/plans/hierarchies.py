"""Queries of problem 2: the hierarchies of `tree`."""

from __future__ import annotations

from chronopanel.operators import hierarchy as H
from chronopanel.sources.tables import table


def _nested(spark, d):
    return H.hierarchy(table(spark, d, "tree"))


def _ranges(spark, d):
    """Without paths, which neither issues nor descendants need."""
    return H.hierarchy(table(spark, d, "tree"), paths=False)


QUERIES = {
    "p2_found": lambda spark, d: H.hierarchy_issues(_ranges(spark, d)),
    "p2_hierarchy": _nested,
    "p2_descendants": lambda spark, d: H.descendant_pairs(_ranges(spark, d)),
}

_CHAIN = """
WITH RECURSIVE latest AS (
  SELECT node_id, parent_id, depth, title FROM (
    SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC) AS rn FROM tree WHERE node_id IS NOT NULL) WHERE rn = 1),
up AS (
  SELECT node_id, node_id AS at, parent_id AS nxt, 1 AS n FROM latest
  UNION ALL
  SELECT u.node_id, l.node_id, l.parent_id, u.n + 1 FROM up u JOIN latest l ON u.nxt = l.node_id WHERE u.n < 200),
size AS (SELECT count(*) AS n FROM latest),
ends AS (
  SELECT u.node_id, u.n AS depth, u.at AS root, u.nxt IS NOT NULL AS orphaned
  FROM up u LEFT JOIN latest p ON u.nxt = p.node_id WHERE p.node_id IS NULL),
cyc AS (SELECT DISTINCT node_id FROM up WHERE nxt = node_id),
out AS (
  SELECT l.node_id, l.depth AS stored, e.depth, e.root,
    CASE WHEN c.node_id IS NOT NULL THEN 'cycle' WHEN e.node_id IS NULL THEN 'no_root'
         WHEN l.parent_id IS NOT NULL AND e.root = l.node_id THEN 'orphan'
         WHEN NOT e.orphaned AND l.depth <> e.depth THEN 'depth' END AS issue
  FROM latest l LEFT JOIN ends e USING (node_id) LEFT JOIN cyc c USING (node_id))
"""

ORACLES = {
    "p2_hierarchy": _CHAIN
    + """, walk AS (SELECT u.node_id, string_agg(coalesce(l.title, ''), ' > ' ORDER BY u.n DESC) AS path, list(u.at ORDER BY u.n DESC) AS ids FROM up u JOIN ends USING (node_id) JOIN latest l ON l.node_id = u.at GROUP BY 1),
    below AS (SELECT u.at AS node_id, count(*) AS size FROM up u JOIN ends USING (node_id) GROUP BY 1),
    pre AS (SELECT w.node_id, path, row_number() OVER (PARTITION BY e.root ORDER BY ids) AS lft FROM walk w JOIN ends e USING (node_id))
    SELECT l.node_id, l.parent_id, l.title, o.stored AS stored_depth, pre.path, o.depth::INT AS depth, o.root AS root_id, pre.lft, pre.lft + b.size - 1 AS rgt, CASE WHEN pre.lft IS NOT NULL THEN b.size - 1 END AS n_descendants, o.issue
    FROM latest l JOIN out o USING (node_id) LEFT JOIN pre USING (node_id) LEFT JOIN below b USING (node_id)""",
    "p2_found": _CHAIN + "SELECT node_id, issue FROM out WHERE issue IS NOT NULL",
    "p2_descendants": _CHAIN
    + """SELECT u.at AS ancestor_id, u.node_id, (u.n - 1)::INT AS distance FROM up u JOIN ends e USING (node_id) WHERE u.n > 1""",
}
