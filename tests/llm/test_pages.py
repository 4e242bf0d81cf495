"""Pages: what they hold, and what is broken in scanned ones."""

import numpy as np
import pytest

from chronopanel.llm import boosting, holdout
from chronopanel.llm import pages as P
from chronopanel.llm import quality as Q
from chronopanel.llm import repair as R

PROSE = "The pressure in the pipe is high when the valve is closed, and the flow of the water through it falls.\nIt was found that the strength of the wall depends on the heat, which the student should explain before\nthe test is made. Each beam has been checked for its strain in the north hall of the old works."


def prose(n):
    """Another text of the same words and lines for each n."""
    swap = ["beam", "pump", "weir", "shaft", "motor"][n % 5]
    return PROSE.replace("pressure", swap).replace("found", f"found in {n}").replace("north", swap)


SHAPE = "page_id long, file_id long, page_no int, method string, ocr_confidence double, text string"


def inputs(spark, rows):
    pages = spark.createDataFrame(rows, SHAPE)
    lines = P.page_lines(pages, "page_id", "text", "file_id", "page_no", "method", "ocr_confidence")
    return pages, lines, P.page_furniture(lines)


def test_boosted_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = np.where(x[:, 0] > 0.6, "a", np.where(x[:, 1] > 0.5, "b", "c")).astype(object)
    m = boosting.Boosted(("a", "b", "c", "never")).fit(x[:400], y[:400]).calibrate(x[400:500], y[400:500])
    p = m.probabilities(x[500:])
    assert np.allclose(p.sum(1), 1) and (np.array(m.classes, object)[p.argmax(1)] == y[500:]).mean() > 0.93
    assert m.probabilities(np.zeros((0, 4))).shape == (0, 4)


def test_holdout_is_told_apart(spark):
    rng = np.random.default_rng(0)
    rows, i = [], 0
    for kind, text in holdout.HOLDOUT * 3:
        w = text.split("\n")
        rng.shuffle(w) if kind != "prose" else None
        rows.append((i, None, 1, "native", None, "\n".join(w)))
        i += 1
    pages, lines, furniture = inputs(spark, rows + [(900, None, 1, "native", None, None), (901, None, 1, "native", None, " \n ")])
    got = {r.page_id: (r.kind, r.probability) for r in Q.page_kinds(pages, lines, furniture).collect()}
    assert 900 not in got and 901 not in got
    want = [k for k, _ in holdout.HOLDOUT * 3]
    right = sum(got[i][0] == k for i, k in enumerate(want))
    assert right >= 0.85 * len(want) and all(0 < p <= 1 for _, p in got.values())


def test_furniture(spark):
    rows = [(i, 1, i, "ocr", 80.0, f"Rapid Column 20{i}6\nC0mplex Beam\n\n{prose(i)}\n- {i + 4} -") for i in range(1, 4)] + [(9, 2, 1, "ocr", 80.0, "Complex Beam\n" + PROSE), (10, None, 11, "ocr", 80.0, "xi"), (11, None, 4, "ocr", 80.0, "[9]\nStrength of the wall\n" + prose(4))]
    rows[1] = (2, 1, 2, "ocr", 80.0, f"Rapid Column 2026\nComplex Beam\n\n{prose(2)}\n- 6 -")
    _, _, f = inputs(spark, rows)
    got = {(r.page_id, r.line_no): r.kind for r in f.collect()}
    assert {(i, 7): "page_number" for i in (1, 2, 3)}.items() <= got.items() and {(i, 2): "running" for i in (1, 2, 3)}.items() <= got.items()
    assert (9, 1) not in got and got[(10, 1)] == "page_number" and (11, 1) not in got and not any(k[1] in (4, 5, 6) for k in got)


def test_damage_and_repair(spark):
    clean = [(100 + i, 50 + i, 1, "native", None, PROSE) for i in range(12)]
    bad = PROSE.replace("pressure in", "prcssure in").replace("student should", "stu-\ndent should").replace("strength of", "strenqth of").replace("valve is", "va1ve is").replace("north", "- north")
    rows = [*clean, (1, 1, 1, "ocr", 70.0, bad), (2, 1, 2, None, 70.0, prose(1) + " The cross-\nsection of the sma11 beam is tes-"), (3, 1, 3, "ocr", 70.0, "ted in the old works. " + prose(2)), (4, 9, 1, "ocr", None, None), (5, 9, 2, "native", None, PROSE.replace("student should", "stu-\ndent should"))]  # not scanned: never a case
    pages, lines, furniture = inputs(spark, rows)
    kinds = spark.createDataFrame([(r[0], "prose") for r in rows if r[5]], "page_id long, kind string")
    got = {(r.page_id, r.line_no, r.kind) for r in R.damaged_lines(lines, furniture, kinds).collect()}
    hyphens = {(p, n) for p, n, k in got if k == "hyphen"}
    broken = [i for i, x in enumerate(bad.split("\n"), 1) if x.endswith("stu-")]
    assert (1, broken[0]) in hyphens and {n for p, n in hyphens if p == 2} == {3, 4}
    assert (1, 1, "misread") in got and (1, 2, "misread") in got and not any(p in (4, 5) or p >= 100 for p, _, _ in got)
    text = {r.page_id: r.text for r in R.paragraphs(lines, furniture, kinds).collect()}
    assert "pressure in the pipe" in text[1] and "student should" in text[1] and "strength of" in text[1] and "- north" in text[1] and "valve is" in text[1]


def test_hyphens_of_compounds_stay(spark):
    clean = [(100 + i, 50 + i, 1, "native", None, prose(i) + "\nIt is a well-known part of a self-made pump, with a state-of-the-art north hall.") for i in range(4)]
    rows = [*clean, (1, 1, 1, "ocr", 70.0, PROSE + "\nA well-\nknown part of the self-\nmade pump in the state-of-the-\nart hall and of its pres-\nsure."), (2, 2, 1, "ocr", 70.0, "beam; 12\nwall; 14\n\nweir; 15")]
    _, lines, furniture = inputs(spark, rows)
    kinds = spark.createDataFrame([(r[0], "table" if r[0] == 2 else "prose") for r in rows], "page_id long, kind string")
    got = R.paragraphs(lines, furniture, kinds).collect()
    text = " ".join(r.text for r in sorted(got, key=lambda r: r.paragraph) if r.page_id == 1)
    assert "well-known part of the self-made pump in the state-of-the-art hall and of its pressure." in text
    assert [r.text for r in sorted(got, key=lambda r: r.paragraph) if r.page_id == 2] == ["beam; 12", "wall; 14", "weir; 15"]


def test_headers_with_a_number_anywhere(spark):
    heads = [f"Vol. {i} of the Journal of Pumps" for i in range(1, 6)] + ["p.1 Mechanics", "Physics - Page l2 of 30 -", "Physics - Page 13 of 30 -"]
    where = [(1, i) for i in range(1, 6)] + [(2, 1), (3, 12), (3, 13)]
    rows = [(i, f, n, "ocr", 80.0, f"{h}\n\n{prose(i)}\nlast line of page {h}{i}") for i, (h, (f, n)) in enumerate(zip(heads, where, strict=True))]
    rows += [(20, 4, 1, "ocr", 80.0, "Year 1998 in review\n\n" + prose(1)), (21, 4, 2, "ocr", 80.0, "Year 1997 in review\n\n" + prose(2))]
    _, _, f = inputs(spark, rows)
    got = {r.page_id for r in f.where("line_no = 1 and kind = 'running'").collect()}
    assert got == {0, 1, 2, 3, 4, 6, 7}


def test_a_page_of_nothing_but_furniture_has_figures(spark):
    rows = [(i, 1, i, "ocr", 80.0, f"Complex Beam\n- {i} -") for i in (1, 2, 3)] + [(9, 2, 1, "native", None, PROSE)]
    pages, lines, furniture = inputs(spark, rows)
    assert {r.page_id: r.words for r in Q.figures(lines, np.zeros((28, 28)), furniture).collect() if r.page_id < 9} == {1: 3, 2: 3, 3: 3}


@pytest.mark.parametrize(("line", "is_number"), [("- 12 -", True), ("Page 3 of 7", True), ("[4]", True), ("xiv", True), ("3/9", True), ("Unit 4", False), ("12 kN", False), ("the", False)])
def test_page_number_lines(spark, line, is_number):
    assert spark.createDataFrame([(line,)], "x string").selectExpr(f"x rlike '{P.PAGE_NUMBER.replace(chr(92), chr(92) * 2)}' as y").first().y == is_number


def test_empty_table(spark):
    pages, lines, furniture = inputs(spark, [])
    assert Q.page_kinds(pages, lines, furniture).count() == 0
    kinds = spark.createDataFrame([], "page_id long, kind string")
    assert R.damaged_lines(lines, furniture, kinds).count() == 0 and R.paragraphs(lines, furniture, kinds).count() == 0
