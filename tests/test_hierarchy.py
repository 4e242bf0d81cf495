"""Hierarchies against walks by hand: cycles, orphans, deep chains, repeated rows, clashing names."""

from datetime import datetime, timedelta

import pytest

from chronopanel.operators import hierarchy as H
from chronopanel.operators import trees

SHAPE = "node_id long, parent_id long, title string, depth int, loaded_at timestamp"
T0 = datetime(2024, 1, 1)


def nested(spark, rows):
    return {r.node_id: r for r in H.hierarchy(spark.createDataFrame(rows, SHAPE)).collect()}


def test_issues_paths_and_ranges(spark):
    rows = [
        (1, None, "a", 1, T0), (2, 1, "b", 2, T0), (3, 2, None, 7, T0), (4, 1, "d", None, T0), (4, 1, "d", None, T0),
        (5, 6, "e", 1, T0), (6, 5, "f", 1, T0), (7, 5, "g", 1, T0), (8, 8, "h", 1, T0), (9, 99, "i", 5, T0), (10, 9, "j", 1, T0),
        (11, 1, "new", 2, T0 + timedelta(1)), (11, 9, "old", 2, T0), (None, 1, "x", 1, T0),
    ]
    n = nested(spark, rows)
    assert set(n) == set(range(1, 12))
    assert {k: v.issue for k, v in n.items() if v.issue} == {3: "depth", 5: "cycle", 6: "cycle", 8: "cycle", 7: "no_root", 9: "orphan"}
    assert n[3].path == "a > b > " and n[3].depth == 3 and n[3].root_id == 1
    assert n[1].n_descendants == 4 and n[1].lft == 1 and n[1].rgt == 5
    assert n[5].path is None and n[5].depth is None and n[7].root_id is None
    assert n[10].root_id == 9 and n[10].issue is None and n[11].title == "new"
    assert sorted(n[k].lft for k in (1, 2, 3, 4, 11)) == [1, 2, 3, 4, 5]


def test_descendants_and_deep_chain(spark):
    rows = [(i, i - 1 if i else None, str(i), i + 1, T0) for i in range(70)] + [(100 + i, 69, "leaf", 71, T0) for i in range(40)]
    h = H.hierarchy(spark.createDataFrame(rows, SHAPE))
    assert h.where("issue is not null").count() == 0
    pairs = {(r.ancestor_id, r.node_id): r.distance for r in H.descendant_pairs(h).collect()}
    want = {(a, b): b - a for a in range(70) for b in range(a + 1, 70)} | {(a, 100 + i): 70 - a for a in range(70) for i in range(40)}
    assert pairs == want


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert H.hierarchy(empty).count() == 0 and H.descendant_pairs(H.hierarchy(empty)).count() == 0
    odd = spark.createDataFrame([(1, None, "a", 1, T0, 5, "x"), (2, 1, "b", 2, T0, 6, "y")], SHAPE + ", id long, up string")
    assert {r.node_id: r.depth for r in H.hierarchy(odd).collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest(spark, seed):
    import random

    rng = random.Random(seed)
    ids = rng.sample(range(10_000), 300)
    parent = {v: (None if rng.random() < 0.1 else rng.choice(ids)) for v in ids}
    n = nested(spark, [(v, p, "t", None, T0) for v, p in parent.items()])
    for v in ids:
        seen, at = [], v
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        want = (None, len(seen)) if at is None else ("cycle" if at == v else "no_root", None)
        assert (n[v].issue, n[v].depth) == want


def test_tree_roles(spark):
    rows = [(1, None, "u", 1, T0), (2, 1, "t", 2, T0), (3, 2, "c", 3, T0), (4, None, "lone", 1, T0)]
    h = H.hierarchy(spark.createDataFrame(rows, SHAPE))
    facts = spark.createDataFrame([(1, False), (2, True), (3, None), (4, None)], "node_id long, excluded boolean")
    got = {r.node_id: (r.role, r.topic_id, r.excluded) for r in trees.roles(h, facts).collect()}
    assert got == {1: ("unit", None, 0), 2: ("topic", 2, 1), 3: ("concept", 2, 1), 4: ("topic", 4, 0)}
    moves = spark.createDataFrame([(1, 3), (3, 4), (2, 77)], "node_id long, new_parent_id long")
    assert {(r.node_id, r.reason) for r in trees.rejected_moves(h, moves).collect()} == {(1, "cycle"), (2, "no such parent")}
