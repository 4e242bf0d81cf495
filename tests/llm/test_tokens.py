"""Tokenizer and packing: the same ids as the public library, and containers that hold everything exactly once."""

import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronopanel.llm import bpe
from chronopanel.llm import packing as K
from chronopanel.llm import tokenizing as T

PATH = P.path("byte_bpe_50k.tiktoken")
TK = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
TK.encode_special_tokens = True
ODD = ["a" * 3000, "Zq9x" * 400, "x  y  z \x1c\x1d a'll I'VE <|endoftext|> 😀😀́", "\n\n\n  x", "   ", "\U0001fae9 new \U00010d4a abc", "é" * 700, "tab\t\t end ", " 　\r\n x", "don't'd'll''s"]


def ids(text):
    return TK.encode(text, add_special_tokens=False).ids


def test_ids_match_the_library(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abc XYZ 019 .,'\n\téß中दब😀") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", None), (901, "", None)], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in T.encode(df).collect()]
    assert len(got) == len(texts) + 3
    for i, v in got:
        assert v == (ids(texts[i]) if i < 900 else [])
    n = {r.doc_id: r.n_tokens for r in T.count_tokens(df).collect()}
    assert n[900] == 0 and all(n[i] == len(ids(t)) for i, t in enumerate(texts))
    assert T.encode(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=8, unique=True))
def test_matrix_equals_heap(pieces):
    e = bpe.encoder(PATH)
    flat, at = e.encode(pieces)
    for i, p in enumerate(pieces):
        assert flat[at[i] : at[i + 1]].tolist() == e._long(p).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"the", b"\xc3\xa9", b"0", b"ing"]), min_size=1, max_size=400))
def test_long_rows_equal_the_heap(parts):
    e = bpe.encoder(PATH)
    piece = b"".join(parts)
    assert e._wide(piece).tolist() == e._long(piece).tolist()


def test_a_piece_of_600_bytes_stays_in_the_rows(monkeypatch):
    e = bpe.encoder(PATH)
    monkeypatch.setattr(e, "_long", lambda _: 1 / 0)
    for piece in (b"abcde" * 120, b"aaa" * 250, "é".encode() * 40_000):
        flat, at = e.encode([piece, b"x"])
        assert flat[at[0] : at[1]].tolist() == ids(piece.decode())
    assert e._wide(b"a").tolist() == ids("a")


def test_packing_holds_everything_once(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 3, 250, 700, 1024, 1500, 2048, rng.randint(1, 2048)]) for _ in range(3000)] + [0, 0, 5000, 4096, 2049]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(9999, None)], "doc_id long, n_tokens long")
    rows = K.pack(df).collect()
    by_doc, by_box = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.container_id is not None:
            by_box.setdefault(r.container_id, []).append(r)
    for i, n in enumerate(sizes):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in parts) == n and (len(parts) == max(1, -(-n // 2048)))
        assert [r.token_from for r in parts] == [2048 * j for j in range(len(parts))]
    for box in by_box.values():
        at = 0
        for r in sorted(box, key=lambda r: r.start):
            assert r.start >= at and r.start // r.tier == (r.start + r.n_tokens - 1) // r.tier and r.n_tokens <= r.tier
            at = r.start + r.n_tokens
        assert at <= 2048 and len({r.step_group for r in box}) == 1
    room: list[int] = []  # first fit, longest first
    for n in sorted((min(2048, n - 2048 * j) for n in sizes for j in range(-(-n // 2048))), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(2048 - n)
        else:
            room[at] -= n
    assert len(by_box) <= len(room)
    assert by_doc[9999][0].container_id is None and by_doc[3000][0].container_id is None
    assert K.pack(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_each_length_as_often_as_it_is_there(counts):
    got: dict[int, int] = {}
    for p in K.plan(counts, 64, (16, 64)):
        assert sum(s * k for s, k in zip(p.sizes, p.used, strict=True)) <= 64 and p.m > 0
        for s, k in zip(p.sizes, p.used, strict=True):
            got[s] = got.get(s, 0) + k * p.m
    assert got == counts


def test_tiers_make_the_plan():
    """Other tiers give other plans; a tier's windows are opened by its own items and filled from shorter ones."""
    counts = {n: 1 + 4000 // n for n in range(1, 2049)}
    plans = {t: K.plan(dict(counts), 2048, t) for t in ((2048,), (512, 2048), (256, 512, 1024, 2048))}
    assert len({tuple((tuple(p.sizes), tuple(p.used), p.m) for p in v) for v in plans.values()}) == 3
    total = sum(s * n for s, n in counts.items())
    for tiers, patterns in plans.items():
        lows = dict(zip(tiers, (0, *tiers), strict=False))
        for p in patterns:
            assert sum(s * k for s, k in zip(p.sizes, p.used, strict=True)) <= p.tier and lows[p.tier] < p.sizes[0] <= p.tier
        assert K.Places(patterns).containers <= -(-total // 2048) + 1


def test_one_length_holds_most_rows(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 100, id % 2000 + 1) as long) as n_tokens")
    rows = K.pack(df).collect()
    assert len({(r.container_id, r.start) for r in rows}) == 5000
