"""Near copies against all pairs, groups, and hot groups of copies."""

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np

from chronopanel.llm import neardup as N


def overlap(a, b):
    x, y = (Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.randint(12, 60))
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = base[:]
            for _ in range(rng.randint(0, len(w) // 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                rng.shuffle(w)
            out.append((" " if rng.random() < 0.5 else ", ").join(w))
    return out


def test_against_all_pairs(spark):
    t = texts(250, 4)
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(t)] + [(7, t[7], "k"), (9000, None, "k"), (9001, "", "k"), (9002, "too short", "k"), (None, t[0], "k")], "id long, text string, n string")
    links, members = N.near_duplicates(df, "id", "text", 0.65, 12)
    got = {(r.id_1, r.id_2) for r in N.expanded_pairs(links, members).collect()}
    want = {(i, j) for i in range(len(t)) for j in range(i + 1, len(t)) if overlap(t[i], t[j]) >= 0.65}
    assert not got - want and len(want - got) <= 0.02 * len(want) and len(want) > 100
    g = {r.id: r.group_id for r in N.groups(links, members).collect()}
    for i, j in got:
        assert g[i] == g[j] <= i
    assert set(g) == {x for p in got for x in p}


def test_many_copies_of_one_text(spark):
    t = texts(40, 8)
    rows = [(i, x) for i, x in enumerate(t)] + [(1000 + i, "Hot  " + t[0].upper() + "!") for i in range(30)] + [(2000 + i, t[0] + " hot") for i in range(30)]
    links, members = N.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.65, 12)
    got = {(r.id_1, r.id_2) for r in N.expanded_pairs(links, members).collect()}
    assert {(i, j) for i in range(1000, 1030) for j in range(2000, 2030)} <= got and (1000, 1001) in got
    assert links.count() < 200


def test_hot_keys_are_spread(spark):
    t = texts(120, 5)
    df, cfg = spark.createDataFrame(list(enumerate(t)), "id long, text string"), N.Banding.at(0.65)
    a = {tuple(r) for r in N.candidates(N.signatures(df, "id", "text", 12, cfg).select("id", "sketch", "keys"), 0.65, cfg).collect()}
    b = {tuple(r) for r in N.candidates(N.signatures(df, "id", "text", 12, cfg).select("id", "sketch", "keys"), 0.65, replace(cfg, hot=1)).collect()}
    assert a == b


def test_pairs_of_equal_values():
    x = np.array([3, 1, 3, 2, 3, 1])
    got = {tuple(sorted((int(a), int(b)))) for p, q in N._pairs_of(x) for a, b in zip(p, q, strict=True)}
    assert got == {(0, 2), (0, 4), (2, 4), (1, 5)}


def test_empty(spark):
    links, members = N.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert links.count() == 0 and members.count() == 0 and N.groups(links, members).count() == 0


def test_recall_at_the_threshold_itself(spark):
    """Pairs whose overlap lies between 0.65 and 0.70: at least 0.95 of them are found, as the banding promises."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(20_000)]
    rows, want = [], set()
    for i in range(3000):
        n = rng.randint(12, 60)
        base = rng.sample(vocab, n)
        for r in range(1, n):
            if 0.65 <= (n - r) / (n + r) < 0.70:
                rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[r:] + rng.sample(vocab, r)))]
                if 0.65 <= overlap(rows[-1][1], rows[-2][1]) < 0.70:
                    want.add((2 * i, 2 * i + 1))
                break
    links, members = N.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.65, 12)
    got = {(r.id_1, r.id_2) for r in N.expanded_pairs(links, members).collect()}
    assert len(want) > 1500 and len(got & want) >= 0.95 * len(want), (len(got & want), len(want))


def test_banding_follows_the_threshold():
    for s in (0.5, 0.65, 0.8, 0.9):
        cfg = N.Banding.at(s)
        assert cfg.chance(s) >= 0.95 and cfg.chance(s) <= cfg.chance(s + 0.05)
    assert N.Banding.at(0.65).a > N.Banding.at(0.8).a


def test_salted_expansion_and_classes(spark, monkeypatch):
    monkeypatch.setattr(N, "SALTED", 3)
    links = spark.createDataFrame([(1, 20, 0.8), (20, 40, 0.7)], "rep_1 long, rep_2 long, overlap double")
    members = spark.createDataFrame([(i, 1) for i in range(1, 12)] + [(i, 20) for i in range(20, 28)], "id long, rep long")
    a, b = set(range(1, 12)), set(range(20, 28))
    want = {(x, y) for x in a for y in a if x < y} | {(x, y) for x in b for y in b if x < y} | {(x, y) for x in a for y in b} | {(x, 40) for x in b}
    rows = [(r.id_1, r.id_2) for r in N.expanded_pairs(links, members).collect()]
    assert len(rows) == len(want) and set(rows) == want
    n = {r.id: (r.class_id, r.n_links) for r in N.linked_classes(links, members).collect()}
    degree = Counter(x for p in want for x in p)
    assert {k: v[1] for k, v in n.items()} == dict(degree) and n[5][0] == 1 and n[40][0] == 40
