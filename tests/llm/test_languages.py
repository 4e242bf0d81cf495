"""Languages: automata against substrings, held-out lines, and odd rows."""

import numpy as np

from chronopanel.llm import languages as L

WORDS = {
    "en": "the water is not high when pressure falls and we find that it was shown by him with these parts",
    "de": "das wasser ist nicht hoch wenn der druck steigt und wir finden dass es mit diesen teilen gezeigt wurde",
    "fr": "la pression est plus haute quand on trouve que les parties sont faibles et ne peut pas dans cette eau",
}


def lines(lang, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang].split(), 9)) + "." for _ in range(n)]


def test_automaton_parses_by_longest_matches():
    text = "abcab xyz"
    symbols = {c: i for i, c in enumerate(sorted(set(text)), 1)}
    a = L.Automaton(text, symbols)
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = "".join(rng.choice(list("abcxyz q"), rng.integers(1, 9)))
        want, i = 0, 0
        while i < len(w):
            j = i
            while j < len(w) and w[i : j + 1] in text:
                j += 1
            i, want = max(j, i + 1), want + 1
        codes = np.array([[symbols.get(c, 0) for c in w]])
        assert a.phrases(codes, np.array([len(w)]))[0] == want, w


def test_documents_lines_and_segments(spark):
    docs, i = [], 0
    for n, lang in enumerate(WORDS):
        for k in range(40):
            label = lang if k % 8 else list(WORDS)[(n + 1) % 3]
            docs.append((i, "\n\n".join(lines(lang, 4, i)), label))
            i += 1
    docs += [(500, "\n".join(lines("en", 2, 500) + [" "] + lines("fr", 3, 501)), "en"), (501, lines("de", 1, 9)[0], None), (502, None, "en"), (503, "", "en"), (504, "12 34\n= 5", "en"), (501, lines("de", 1, 9)[0], None), (505, lines("fr", 1, 3)[0].upper(), "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    codes = spark.createDataFrame([(x, x) for x in WORDS], "label string, lang string")
    m = L.fit(df, codes)
    found = {(r.doc_id, r.line_no): r.lang for r in L.wrong_lines(df, codes, model=m).distinct().collect()}
    assert {(500, 3): "fr", (500, 4): "fr", (500, 5): "fr", (501, 1): "de", (505, 1): "fr"}.items() <= found.items()
    assert not any(k[0] in (502, 503, 504) for k in found)
    wrong = {d[0]: list(WORDS)[d[0] // 40] for d in docs[:120] if d[2] != list(WORDS)[d[0] // 40]}
    assert {k: v for k, v in found.items() if k[0] < 120} == {(d, n): lang for d, lang in wrong.items() for n in range(1, 5)}
    seg = {(r.segment, r.first_line, r.last_line, r.lang) for r in L.segments(L.line_languages(df.where("doc_id = 500"), m)).collect()}
    assert seg == {(1, 1, 2, "en"), (2, 3, 5, "fr")}
    d = {r.doc_id: r for r in L.document_languages(df.dropDuplicates(["doc_id"]), codes, model=m).collect()}
    assert d[500].lang == "fr" and d[500].mixed and not d[500].label_ok and d[1].label_ok and d[504].lang is None and d[502].lang is None
    assert 0 < d[1].confidence <= 1


def test_a_line_that_changes_language(spark):
    docs = [(i, "\n".join(lines(lang, 6, 50 * n + i)), lang) for n, lang in enumerate(WORDS) for i in range(n * 40, n * 40 + 40)]
    one, two = " ".join(lines("en", 1, 900)).rstrip("."), " ".join(lines("de", 2, 901))
    df = spark.createDataFrame([*docs, (500, f"{one} {two}\n{one}", "en")], "doc_id long, text string, lang string")
    codes = spark.createDataFrame([(x, x) for x in WORDS], "label string, lang string")
    m = L.fit(df, codes)
    seg = L.segments(L.line_languages(df.where("doc_id = 500"), m)).orderBy("segment").collect()
    assert [r.lang for r in seg] == ["en", "de", "en"] and [(r.first_line, r.last_line) for r in seg] == [(1, 1), (1, 1), (2, 2)]
    assert abs(seg[1].first_word - 10) <= 1 and seg[1].last_word == 27 and all(0.5 < r.confidence <= 1 for r in seg)
    # The line's language is that of most of its words.
    assert {(r.line_no, r.lang) for r in L.wrong_lines(df.where("doc_id = 500"), codes, model=m).collect()} == {(1, "de")}
    d = L.document_languages(df.where("doc_id = 500"), codes, model=m).first()
    assert d.mixed and d.label_ok == (d.lang == "en")


def test_matches_cross_words_and_long_lines_are_parsed(spark):
    symbols = {c: i for i, c in enumerate(sorted(set("the water is high")), 1)}
    text = "the water is high"
    m = L.Model(["x"], symbols, L.Parser([L.Automaton(text, symbols)]), np.array([1.0]))
    assert m.costs([["water", "is"]]).sum() == 1 and m.costs([["is", "water"]]).sum() == 2
    many = [["water", "is"] * 5000, [], ["the"]]
    cost = m.costs(many)
    assert cost.shape == (10_001, 1) and cost[:64].sum() == 32 and cost[-1] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    codes = spark.createDataFrame([("en", "en")], "label string, lang string")
    assert L.wrong_lines(df, codes).count() == 0
