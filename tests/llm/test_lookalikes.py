"""Consistent forms: what doesn't change the look, what does, and pairs without copies of one text."""

import unicodedata

import pytest

from chronopanel.llm import lookalikes as A

SAME = [("ﬁnd", "find"), ("ｆｉｎｄ", "find"), ("te​st", "test"), ("a b", "a b"), ("état", "état"), ("сat", "cat"), ("Αlpha", "Alpha"), ("cross‑section", "cross-section"), ("﻿x", "x"), ("ＡＢ－１", "AB-1"), ("е́", "é"), ("a\r\nb", "a\nb"), ("so­ft", "soft"), ("Ⅳ", "IV"), ("Å", "Å"), ("µ", "μ"), ("𝐀bc", "Abc"), ("𝟏𝟐", "12"), ("Ꭺbc", "Abc")]
OTHER = [("a", "A"), ("etat", "état"), ("x2", "x²"), ("CO2", "CO₂"), ("a−b", "a-b"), ("ρ", "p"), ("α", "a"), ("a  b", "a b"), ("a\nb", "a b"), ("word", "ward")]


@pytest.fixture(scope="module")
def form(spark):
    texts = sorted({t for p in SAME + OTHER for t in p} | {""})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id long, text string")
    got = {r.id: r.form for r in A.forms(df, "text", "id").collect()}
    assert got[999] is None
    return {t: got[i] for i, t in enumerate(texts)}


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(form, a, b):
    assert form[a] == form[b] == unicodedata.normalize("NFC", b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(form, a, b):
    assert form[a] != form[b]


def test_hot_classes_meet_in_slices(spark, monkeypatch):
    monkeypatch.setattr(A, "SALTED", 3)
    df = spark.createDataFrame([(i, "find") for i in range(10)] + [(100 + i, "ﬁnd") for i in range(8)], "id long, text string")
    got = [(r.id_1, r.id_2) for r in A.alike_pairs(df, "id", "text").collect()]
    assert len(got) == 80 and set(got) == {(a, 100 + b) for a in range(10) for b in range(8)}


def test_pairs(spark):
    rows = [(1, "find", 1), (2, "ﬁnd", 1), (3, "find", 1), (4, "find", 2), (5, "Find", 1), (6, None, 1), (7, "", 1), (8, "​", 1), (9, "ﬁnd", None), (10, "f​ind", 1)]
    df = spark.createDataFrame(rows, "id long, text string, form int")
    got = {(r.id_1, r.id_2) for r in A.alike_pairs(df, "id", "text", "form").collect()}
    assert got == {(1, 2), (2, 3), (7, 8), (1, 10), (2, 10), (3, 10)}
    assert A.alike_pairs(df.where("false"), "id", "text").count() == 0
