"""Queries of the text functions, over questions, pages, exams and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions import text as T
from chronopanel.operators.panel import exams_once
from chronopanel.plans.panels import rounded
from chronopanel.sources.tables import table


def _q(spark, d):
    return table(spark, d, "questions").where("question_id is not null").select("question_id", "text").distinct()


def _pages(spark, d):
    return table(spark, d, "document_page").where("page_id is not null").select("page_id", "text", "ocr_confidence").distinct()


def _join(c):
    return F.array_join(c, "|")


_MARKS = ["6", "2+4", "5x2", "2×4", "2x3+4", "x", "", "1.5+2", "4 * 2"]
_ROMANS = ["1", "12", "i", "iv", "ix", "xiv", "XX", "xxxix", "abc", "vx"]

QUERIES = {
    "text_clean": lambda s, d: _pages(s, d).select("page_id", F.md5(T.clean_text(F.col("text"))).alias("h"), F.length(T.clean_text(F.col("text"))).cast("long").alias("n")),
    "text_math": lambda s, d: _q(s, d).select("question_id", T.normalize_math(F.col("text")).alias("text")),
    "text_normalized": lambda s, d: _q(s, d).select("question_id", T.normalize_for_matching(F.col("text")).alias("text")),
    "text_tokens": lambda s, d: _q(s, d).select("question_id", _join(T.tokens(F.col("text"))).alias("tokens"), F.size(T.tokens(F.col("text"))).cast("long").alias("n")).where("tokens is not null"),
    "content_terms": lambda s, d: _q(s, d).where("text is not null").select("question_id", _join(T.content_terms(F.col("text"), False)).alias("terms")),
    "content_stems": lambda s, d: _q(s, d).where("text is not null").select("question_id", _join(T.content_terms(F.col("text"))).alias("terms")),
    "word_counts": lambda s, d: table(s, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length(T.collapse_whitespace(F.col("text"))).cast("long").alias("chars")),
    "implausible_tokens": lambda s, d: _q(s, d).select("question_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]{2,}"), F.lit(0))).alias("w")).groupBy("question_id").agg(F.count("*").alias("n"), F.count(F.when(T.implausible_token(F.col("w")), 1)).alias("bad")),
    "quality_flags": lambda s, d: _pages(s, d).select("page_id", _join(T.text_flags(F.col("text"), F.col("ocr_confidence"))).alias("flags")),
    "garbage_ratio": lambda s, d: rounded(_pages(s, d).where("text is not null").select("page_id", T.garbage_ratio(F.col("text")).alias("garbage"), T.unbalanced(F.col("text")).cast("int").alias("unbalanced"), T.broken_math(F.col("text")).cast("int").alias("broken"))),
    "marks_expressions": lambda s, d: s.createDataFrame([(x,) for x in _MARKS], "expr string").select("expr", T.marks_expression(F.col("expr")).alias("marks")),
    "trailing_marks": lambda s, d: _q(s, d).where("text is not null").select("question_id", T.trailing_marks(F.col("text")).alias("m")).select("question_id", "m.marks", "m.how").where("how is not null"),
    "clean_questions": lambda s, d: _q(s, d).where("text is not null").select("question_id", T.clean_question(F.col("text")).alias("text")),
    "question_types": lambda s, d: rounded(_q(s, d).where("text is not null").select("question_id", T.question_type(F.col("text")).alias("q")).select("question_id", "q.type", _join(F.col("q.types")).alias("types"), F.col("q.confidence").alias("confidence"))),
    "format_labels": lambda s, d: _q(s, d).where("text is not null").select("question_id", T.format_labels(F.col("text")).alias("l")).select("question_id", _join("l").alias("labels"), _join(T.families_of(F.col("l"))).alias("families")),
    "year_sessions": lambda s, d: exams_once(table(s, d, "exams")).select("course_id", "t", F.regexp_extract("label", r"((?:19[5-9]|20\d)\d)", 1).alias("year_text"), T.session_of(F.col("label")).alias("session"), T.exam_type_of(F.col("label")).alias("exam_type")),
    "order_index": lambda s, d: exams_once(table(s, d, "exams")).select("course_id", "t", T.order_index(F.col("year"), F.col("calendar"), T.session_of(F.col("label")), T.exam_type_of(F.col("label"))).alias("order_index")),
    "page_metadata": lambda s, d: _pages(s, d).select(
        "page_id", F.nullif(F.regexp_extract("text", r"\b([A-Z]{2}\d{3})\b", 1), F.lit("")).alias("code"), T.hours_of(F.col("text")).alias("hours"), F.nullif(F.regexp_extract("text", r"Set ([A-D])\b", 1), F.lit("")).alias("paper_set"), F.nullif(F.regexp_extract("text", r"(?:Examination|Paper) ((?:19|20)\d\d)", 1), F.lit("")).cast("int").alias("year"),
    ).where("code is not null or hours is not null or paper_set is not null or year is not null"),
    "roman_numbers": lambda s, d: s.createDataFrame([(x,) for x in _ROMANS], "label string").select("label", T.roman_or_int(F.col("label")).alias("value")),
    "line_kinds": lambda s, d: _pages(s, d).select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).groupBy("page_id", T.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n")),
    "joined_lines": lambda s, d: _pages(s, d).where("text is not null").select("page_id", F.size(F.split(T.wrapped_lines_joined(F.col("text")), "\n")).cast("long").alias("lines"), F.length(T.wrapped_lines_joined(F.col("text"))).cast("long").alias("chars")),
    "file_hashes": lambda s, d: _q(s, d).where("text is not null").select("question_id", F.sha2("text", 256).alias("sha")),
}

_QS = "WITH q AS (SELECT DISTINCT question_id, text FROM questions WHERE question_id IS NOT NULL), pg AS (SELECT DISTINCT page_id, text, ocr_confidence FROM document_page WHERE page_id IS NOT NULL) "


def _sql_clean(x: str) -> str:
    x = f"translate({x}, '‘’‚“”„–—−…{chr(0xA0)}{chr(0x2002)}{chr(0x2009)}{chr(0x202F)}{chr(0x3000)}', '''''''\"\"\"---.{' ' * 5}')"
    x = f"regexp_replace({x}, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}]', '', 'g')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace(replace({x}, chr(9), '    '), '[\\x01-\\x09\\x0B-\\x1F\\x7F]', ' ', 'g')"
    return f"regexp_replace({x}, '\\n[ ]*\\n([ ]*\\n)+', E'\\n\\n', 'g')"


def _sql_math(x: str) -> str:
    y = x
    for a, b in T.FRACTIONS.items():
        y = f"replace({y}, '{a}', '{b}')"
    y = f"regexp_replace({y}, '([A-Za-z)])([{T.LOWERED[:10]}]+)', '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    y = f"regexp_replace({y}, '([{T.RAISED}]+)', '^\\1', 'g')"
    y = f"regexp_replace({y}, '(^|[^\\x01{T.LOWERED}])([{T.LOWERED}]+)', '\\1_\\2', 'g')"
    y = f"translate({y}, '{T.RAISED}{T.LOWERED}' || chr(1) || chr(2), '{T.RAISED_PLAIN}{T.LOWERED_PLAIN}')"
    for a, b in (T.GREEK | T.MATH_SYMBOLS).items():
        y = f"replace({y}, '{a}', ' {b} ')"
    return f"trim(regexp_replace({y}, ' {{2,}}', ' ', 'g'), ' ')"


def _sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_TOK = "regexp_extract_all(lower(text), '[\\p{L}][\\p{L}\\p{N}]*|[0-9]+(?:\\.[0-9]+)?')"
_SKIP = "[" + ", ".join(f"'{w}'" for w in T.SKIPPED) + "]"
_KEPT = f"list_filter({_TOK}, lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9]') AND NOT list_contains({_SKIP}, t))"
_ORDERED = "list_filter(l, lambda v, i: list_position(l, v) = i)"
_LET = "regexp_replace(w, '[^\\p{L}]', '', 'g')"
_FINE = f"(length(w) < 4 OR {_LET} = '' OR (regexp_full_match(w, '[^\\p{{Ll}}]{{1,6}}') AND regexp_matches(w, '\\p{{Lu}}')) OR regexp_matches(w, '^(?:[A-Z][a-z]?[0-9]*){{1,4}}$|^[a-z]{{1,3}}[0-9]$|^[0-9]+[a-zA-Z]{{1,4}}$'))"
_CAPS = "(len(regexp_extract_all(w[2:], '[A-Z]')) >= 2 AND len(regexp_extract_all(w[2:], '[a-z]')) >= 2 AND NOT regexp_matches(w, '^[A-Z][a-z]+[A-Z][a-z]+$'))"
_BAD = f"(NOT {_FINE} AND ((NOT regexp_matches({_LET}, '(?i)[aeiouy]') AND length({_LET}) >= 4) OR regexp_matches(w, '(?i)[bcdfghjklmnpqrstvwxz]{{5}}') OR len(list_filter(range(1, length(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3])) > 0 OR regexp_matches(w, '^[A-Za-z]+[0-9][A-Za-z]+$') OR {_CAPS}))"
_GARB = "CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) > 0 THEN length(regexp_replace(text, '[\\s\\p{L}\\p{M}\\p{N}.,;:!?''\"()\\[\\]{}/%+=*<>&@#_-]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g')) ELSE 0 END"
_N = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_UNB = f"({_N('\\(')} <> {_N('\\)')} OR {_N('\\[')} <> {_N('\\]')})"
_BRK = "regexp_matches(text, '[=+*/]\\s*$|[=+*/]\\s*[=*/]|^\\s*[=*/]')"
_HITS = lambda p: f"len(regexp_extract_all(lower(text), '{p}'))"


def _sql_scores() -> str:
    rows = []
    for i, (name, p, w) in enumerate(T.TYPE_PATTERNS):
        s = f"CASE WHEN {_HITS(p)} > 0 THEN {w} * (1 + 0.25 * ({_HITS(p)} - 1)) ELSE 0 END"
        if name == "numerical":
            s += " + CASE WHEN regexp_matches(lower(text), '\\d+(?:\\.\\d+)?\\s*(?:[kmg]?(?:pa|n|j|w|v|a|hz|m|mm|cm|kg|s|k|ohm|bar|rpm|litres|min|mol))\\b') THEN 0.8 ELSE 0 END"
        rows.append(f"{{'score': ({s})::DOUBLE, 'o': {-i}, 'type': '{name}'}}")
    return "[" + ", ".join(rows) + "]"


_MARKEXPR = "list_sum([list_reduce([v::DOUBLE FOR v IN string_split(t, 'x')], lambda a, b: a * b) FOR t IN string_split(translate(regexp_replace({0}, '\\s', '', 'g'), '×*', 'xx'), '+')])"
_EX = "\\d+(?:\\.\\d+)?(?:\\s*[x×*+]\\s*\\d+)*"
_LABEL_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in T.LABEL_PATTERNS.items()) + "], lambda v: v IS NOT NULL)"
_FAM_SQL = "list_filter([" + ", ".join(f"CASE WHEN list_has_any(l, {list(m)}) THEN '{n}' END" for n, m in T.FAMILIES.items()) + "], lambda v: v IS NOT NULL)"
_SESSION = "coalesce(" + ", ".join([f"CASE WHEN contains(lower(label), '{m}') THEN '{m}' END" for m in T.MONTHS] + [f"CASE WHEN regexp_matches(lower(label), '\\b{s}\\b') THEN '{s}' END" for s in T.SEASONS]) + ")"
_TYPE = "CASE WHEN regexp_matches(lower(label), '\\b(re-?sit|back)\\b') THEN 're-sit' WHEN regexp_matches(lower(label), '\\bregular\\b') THEN 'regular' WHEN regexp_matches(lower(label), '\\bmodel\\b') THEN 'model' WHEN regexp_matches(lower(label), '\\bfinal\\b') THEN 'final' WHEN regexp_matches(lower(label), '\\b(mid|internal)') THEN 'internal' END"
_FRAC = "coalesce(" + ", ".join([f"CASE WHEN {_SESSION} = '{m}' THEN {(i + 0.5) / 12!r}::DOUBLE END" for i, m in enumerate(T.MONTHS)] + [f"CASE WHEN {_SESSION} = '{s}' THEN {v}::DOUBLE END" for s, v in T.SEASONS.items()]) + ", 0.5::DOUBLE)"
_EXS = "SELECT DISTINCT course_id, t, exam_id, ord, label, total_marks, year, calendar, source_kind FROM exams"
_LINE = [("or", "(?i)^\\(?or\\)?$"), ("section", "(?i)^(section|group|part)\\s+[\"'']?[a-z0-9]\\b"), ("instruction", "(?i)^(attempt|answer|instructions?|candidates)\\b"), ("marks", "^\\[?\\s*\\d+(?:\\s*[x×+]\\s*\\d+)*\\s*\\]?$"), ("main_sub", "^\\d{1,2}[.)]?\\s*\\([a-z]\\)"), ("dotted", "^\\d+(?:\\.\\d+)+\\.?\\s"), ("main", "^(?:Q\\s*)?\\(?\\d{1,3}[.):]\\)?\\s"), ("roman", "^\\(?[ivx]+[.)]\\s"), ("letter", "^\\(?[a-zA-Z][.)]\\s")]

FLAG_LIST = f"list_filter([CASE WHEN e THEN 'empty' END, CASE WHEN NOT e AND g > 0.25 THEN 'garbled' END, CASE WHEN NOT e AND b > 0.3 THEN 'implausible' END, CASE WHEN NOT e AND {_UNB} THEN 'unbalanced' END, CASE WHEN NOT e AND {_BRK} THEN 'broken_equation' END, CASE WHEN NOT e AND n < 3 THEN 'short' END, CASE WHEN NOT e AND n > 400 THEN 'long' END, CASE WHEN ocr_confidence < 60 THEN 'low_confidence' END], lambda v: v IS NOT NULL)"
FLAG_COLUMNS = f"coalesce(trim(text, ' ') = '', true) AS e, {_GARB} AS g, len(regexp_extract_all(text, '\\S+')) AS n, coalesce(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9]{{2,}}'), lambda w: {_BAD})) / nullif(len(regexp_extract_all(text, '[A-Za-z0-9]{{2,}}')), 0), 0) AS b"
CLEAN_QUESTION = f"trim(regexp_replace(regexp_replace({_sql_collapse('text')}, '^\\s*(?:Q\\s*\\d+\\s*[:.)]|\\(?\\d{{1,3}}[.)]|\\(?[a-hivx]{{1,4}}\\))\\s*', ''), '\\s*(?:\\[\\s*[\\d+x×* ]+\\s*\\]|\\(\\s*\\d+(?:\\s*marks?)?\\s*\\))\\s*$', ''))"
ORACLES = {
    "text_clean": _QS + f"SELECT page_id, md5({_sql_clean('text')}) AS h, length({_sql_clean('text')}) AS n FROM pg",
    "text_math": _QS + f"SELECT question_id, {_sql_math('text')} AS text FROM q",
    "text_normalized": _QS + f"SELECT question_id, lower({_sql_collapse(_sql_math(_sql_clean('text')))}) AS text FROM q",
    "text_tokens": _QS + f"SELECT question_id, array_to_string({_TOK}, '|') AS tokens, len({_TOK}) AS n FROM q WHERE text IS NOT NULL",
    "content_terms": _QS + f"SELECT question_id, coalesce(array_to_string({_ORDERED}, '|'), '') AS terms FROM (SELECT question_id, {_KEPT} AS l FROM q WHERE text IS NOT NULL)",
    "content_stems": _QS + f"SELECT question_id, coalesce(array_to_string({_ORDERED}, '|'), '') AS terms FROM (SELECT question_id, [CASE WHEN length(w) > 5 THEN regexp_replace(w, '(?:ations?|ings?|edly|ed|ies|es|s)$', '') ELSE w END FOR w IN {_KEPT}] AS l FROM q WHERE text IS NOT NULL)",
    "word_counts": f"SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, length({_sql_collapse('text')}) AS chars FROM documents",
    "implausible_tokens": _QS + f"SELECT question_id, count(*) AS n, count(*) FILTER (WHERE {_BAD}) AS bad FROM (SELECT question_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{{2,}}')) AS w FROM q) GROUP BY 1",
    "quality_flags": _QS + f"SELECT page_id, coalesce(array_to_string({FLAG_LIST}, '|'), '') AS flags FROM (SELECT *, {FLAG_COLUMNS} FROM pg)",
    "garbage_ratio": _QS + f"SELECT page_id, round({_GARB} + 1e-10, 6) AS garbage, {_UNB}::INT AS unbalanced, {_BRK}::INT AS broken FROM pg WHERE text IS NOT NULL",
    "marks_expressions": "SELECT expr, CASE WHEN regexp_full_match(expr, '\\s*\\d+(?:\\.\\d+)?(?:\\s*[x×*+]\\s*\\d+(?:\\.\\d+)?)*\\s*') THEN " + _MARKEXPR.format("expr") + " END AS marks FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in _MARKS) + "]) AS expr)",
    "trailing_marks": _QS
    + f"""SELECT question_id, {_MARKEXPR.format('coalesce(a, b, c, d, e)')} AS marks, CASE WHEN a IS NOT NULL THEN 'bracket' WHEN b IS NOT NULL THEN 'word in parentheses' WHEN c IS NOT NULL THEN 'word' WHEN d IS NOT NULL THEN 'parentheses' ELSE 'margin' END AS how
    FROM (SELECT question_id, nullif(regexp_extract(text, '\\[\\s*({_EX})\\s*\\]\\s*$', 1), '') AS a, nullif(regexp_extract(text, '(?i)\\(\\s*({_EX})\\s*marks?\\s*\\)\\s*$', 1), '') AS b, nullif(regexp_extract(text, '(?i)({_EX})\\s*marks?\\s*$', 1), '') AS c,
    nullif(regexp_extract(text, '\\(\\s*({_EX})\\s*\\)\\s*$', 1), '') AS d, nullif(regexp_extract(text, '\\S {{4,}}(\\d{{1,2}})\\s*$', 1), '') AS e FROM q) WHERE coalesce(a, b, c, d, e) IS NOT NULL""",
    "clean_questions": _QS + f"SELECT question_id, {CLEAN_QUESTION} AS text FROM q WHERE text IS NOT NULL",
    "question_types": _QS
    + f"SELECT question_id, CASE WHEN top.score > 0 THEN top.type ELSE 'theory' END AS type, CASE WHEN top.score > 0 THEN array_to_string([r.type FOR r IN s IF r.score > 0 AND r.score >= 0.5 * top.score], '|') ELSE 'theory' END AS types, round(least(1.0, top.score / 1.5) + 1e-10, 6) AS confidence FROM (SELECT *, list_max(s) AS top FROM (SELECT question_id, {_sql_scores()} AS s FROM q WHERE text IS NOT NULL))",
    "format_labels": _QS + f"SELECT question_id, coalesce(array_to_string(l, '|'), '') AS labels, coalesce(array_to_string({_FAM_SQL}, '|'), '') AS families FROM (SELECT question_id, {_LABEL_SQL} AS l FROM q WHERE text IS NOT NULL)",
    "year_sessions": f"SELECT course_id, t, regexp_extract(label, '((?:19[5-9]|20\\d)\\d)', 1) AS year_text, {_SESSION} AS session, {_TYPE} AS exam_type FROM ({_EXS})",
    "order_index": f"SELECT course_id, t, CASE WHEN year IS NULL THEN 0 ELSE round(CASE WHEN calendar = 'BS' THEN year - 56.7::DOUBLE ELSE year::DOUBLE END + least(greatest({_FRAC}, 0), 0.99::DOUBLE) * 0.98::DOUBLE + CASE WHEN {_TYPE} = 're-sit' THEN 0.01::DOUBLE ELSE 0 END, 4) END AS order_index FROM ({_EXS})",
    "page_metadata": _QS
    + "SELECT * FROM (SELECT page_id, nullif(regexp_extract(text, '\\b([A-Z]{2}\\d{3})\\b', 1), '') AS code, nullif(regexp_extract(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:hours?|hrs?)\\b', 1), '')::DOUBLE AS hours, nullif(regexp_extract(text, 'Set ([A-D])\\b', 1), '') AS paper_set, nullif(regexp_extract(text, '(?:Examination|Paper) ((?:19|20)\\d\\d)', 1), '')::INT AS year FROM pg) WHERE code IS NOT NULL OR hours IS NOT NULL OR paper_set IS NOT NULL OR year IS NOT NULL",
    "roman_numbers": "SELECT * FROM (VALUES ('1', 1), ('12', 12), ('i', 1), ('iv', 4), ('ix', 9), ('xiv', 14), ('XX', 20), ('xxxix', 39), ('abc', NULL), ('vx', NULL)) v(label, value)",
    "line_kinds": _QS
    + "SELECT page_id, CASE "
    + " ".join(f"WHEN regexp_matches(trim(line, ' '), '{p}') THEN '{k}'" for k, p in _LINE)
    + " ELSE 'text' END AS kind, count(*) AS n FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS line FROM pg) GROUP BY ALL",
    "joined_lines": _QS + "SELECT page_id, len(string_split(j, chr(10))) AS lines, length(j) AS chars FROM (SELECT page_id, regexp_replace(text, '[ ]*\\n[ ]*(\\p{Ll})', ' \\1', 'g') AS j FROM pg WHERE text IS NOT NULL)",
    "file_hashes": _QS + "SELECT question_id, sha256(text) AS sha FROM q WHERE text IS NOT NULL",
}
