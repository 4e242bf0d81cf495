"""Text functions, fuzzy ratios, parsers, files and streams on small known cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from chronopanel.functions import text as T
from chronopanel.operators import parsing as P
from chronopanel.operators import recurrence as R
from chronopanel.operators import review as V
from chronopanel.operators import vectors as Z
from chronopanel.sources import files, sinks
from chronopanel.streaming import flows


def one(spark, value, f, shape="string"):
    return spark.createDataFrame([(value,)], f"x {shape}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("x", "want"), [("2+4", 6), ("5x2", 10), ("2×4", 8), ("2x3+4", 10), ("abc", None), ("", None), (None, None)])
def test_marks(spark, x, want):
    assert one(spark, x, T.marks_expression) == want


@pytest.mark.parametrize(("x", "want"), [("Define entropy. [4]", (4, "bracket")), ("Explain the cycle.        6", (6, "margin")), ("Find the velocity at x = 5", (None, None)), ("State it. (3 marks)", (3, "word in parentheses"))])
def test_trailing_marks(spark, x, want):
    assert tuple(one(spark, x, T.trailing_marks)) == want


def test_types_and_flags(spark):
    assert one(spark, "Calculate the power at 5 kW and draw the diagram.", T.question_type).type in ("numerical", "diagram")
    assert one(spark, "Something else entirely.", T.question_type).type == "theory"
    assert one(spark, "", T.text_flags) == ["empty"] and one(spark, None, T.text_flags) == ["empty"]
    assert "unbalanced" in one(spark, "the value (of it is known well", T.text_flags)
    assert one(spark, "A‘b’ ﬁn​d\tit", T.clean_text) == "A'b' find    it"


def test_ratios():
    assert R.indel_ratio("abc", "abc") == 100 and R.indel_ratio("abc", "xyz") == 0 and R.indel_ratio("", "") == 100
    assert abs(R.indel_ratio("kitten", "sitting") - 100 * 8 / 13) < 1e-9
    assert R.token_sort_ratio("b a", "a b") == 100 and R.token_set_ratio("a b c", "a b") == 100


def test_paper_and_syllabus(spark):
    text = "Final Examination 2020\n1. Define flow. [2]\n2. Answer both:\n(a) State the law. [3]\n(b) Derive it. [5]\nOR\n3. Explain the cycle.\n[2x4]"
    pages = spark.createDataFrame([(7, 1, text), (8, 1, None), (None, 1, "1. x")], "file_id long, page_no int, text string")
    rows = P.parse_papers(pages).orderBy("q_no").collect()
    assert [(r.label, r.parent_no, r.marks) for r in rows] == [("1", None, 2), ("2", None, 8), ("a", 2, 3), ("b", 2, 5), ("3", None, 8)]
    assert rows[4].or_group == rows[1].or_group is not None and rows[4].is_optional
    assert P.split_labels("Do (a) one thing (b) another") == [("a", "one thing"), ("b", "another")]
    assert P.split_concepts("beams, arches (stone, steel) and domes") == ["beams", "arches (stone, steel)", "domes"]
    syl = spark.createDataFrame([(1, 1, "1. Flow: pipes, pumps (3 hours)\n1.1 Losses")], "file_id long, page_no int, text string")
    got = P.parse_syllabus(syl).orderBy("node_no").collect()
    assert (got[0].title, got[0].hours, got[0].concepts, got[1].parent_no, got[1].depth) == ("Flow", 3.0, ["pipes", "pumps"], 1, 2)


def test_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t><w:br w:type="page"/><w:t>Two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.txt").write_bytes("é1\fé2".encode("cp1252"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 x")
    f = files.read_files(spark, str(tmp_path))
    pages = {(r.path.rsplit("/", 1)[-1], r.page_no): r.text for r in files.extract_pages(f).collect()}
    assert pages == {("a.docx", 1): "One", ("a.docx", 2): "Two\na    b", ("b.txt", 1): "é1", ("b.txt", 2): "é2", ("c.pdf", None): None}
    assert files.new_files(f, f.where("kind = 'pdf'")).count() == 2
    assert files.decode("x".encode("utf-16")) == "x"
    boxes = spark.createDataFrame([(1, 0.0, 30.0, "abc"), (1, 33.0, 20.0, "de"), (1, 200.0, 10.0, "f")], "line int, x double, width double, word string")
    assert files.lines_of_boxes(boxes, ["line"]).first().text == "abc de    f"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], float("nan"))], "a int, b array<int>, c double")
    sinks.save_run(df, f"{tmp_path}/runs", 1)
    sinks.save_run(df.withColumn("a", F.lit(2)), f"{tmp_path}/runs", 2)
    sinks.save_run(df.withColumn("a", F.lit(3)), f"{tmp_path}/runs", 2)
    t = spark.read.parquet(f"{tmp_path}/runs")
    assert sorted(r.a for r in t.collect()) == [1, 3] and sinks.latest_run(t).first().a == 3
    sinks.export_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().b == "[1,2]"
    assert sinks.as_json(df).first().json == '{"a":1,"b":[1,2]}'


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1), (2, 0, 0)], "k long, t int, y long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = flows.item_state(flows.file_stream(spark, f"{tmp_path}/in", "k long, t int, y long"))
    flows.run_to_table(s, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {(r.k, r.t): (r.seen, r.streak, r.since) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 0): (1, 1, 0), (1, 1): (1, 0, 1), (1, 2): (2, 1, 0), (2, 0): (0, 0, 1)}
    flows.upsert_batches(flows.file_stream(spark, f"{tmp_path}/in", "k long, t int, y long"), f"{tmp_path}/up", f"{tmp_path}/ck2", "k", "t")
    assert {(r.k, r.t) for r in spark.read.parquet(f"{tmp_path}/up/batch=0").collect()} == {(1, 2), (2, 0)}


def test_vectors_and_links(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(200)] + [(500, None)], "id long, e array<float>")
    q = v.where("id < 5").select(F.col("id").alias("query_id"), "e")
    got = Z.vector_search(v, "id", "e", q, 4, rows=40, block=2).collect()
    data = {i: (i % 7, i % 3, 1) for i in range(200)}
    for i in range(5):
        want = sorted(data, key=lambda j: (-sum(a * b for a, b in zip(data[i], data[j], strict=True)), j))[:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want
    t = spark.createDataFrame([(1, i, w) for i, ws in enumerate(["a b c d", "a b c d", "a b c e", "x y z", "q"]) for w in ws.split()], "s int, question_id long, term string")
    links = {(r.id_1, r.id_2): r.relation for r in R.recurrence_links(t, ["s"]).collect()}
    assert links == {(0, 1): "exact", (0, 2): "paraphrase", (1, 2): "paraphrase"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "id_1 long, id_2 long")
    comp = {r.id: r.component for r in R.components(chain).collect()}
    assert all(comp[i] == 0 for i in range(41)) and comp[101] == 100


def test_overlay_and_fingerprint(spark):
    rows = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 1.0, "c")], "id long, marks double, other string")
    edits = spark.createDataFrame([(1, 1, 9.0, False), (1, 2, 7.0, False), (3, 1, None, True)], "id long, seq int, marks double, deleted boolean")
    assert {(r.id, r.marks, r.edited) for r in V.overlay(rows, edits, "id", ["marks"]).collect()} == {(1, 7.0, 1), (2, None, 0)}
    a, b = V.fingerprint(rows, F.col("id"), "marks"), V.fingerprint(rows.where("id < 3").withColumn("marks", F.coalesce("marks", F.lit(5.0))), F.col("id"), "marks")
    assert {(r.part, r.change) for r in V.changed_parts(a, b).collect()} == {(2, "changed"), (3, "removed")}
