"""Text functions as column expressions: normalisation, tokens, quality flags, marks, question types, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words, words that say what to do, and units; none of them is a content term.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before
being below between both but by can cannot could couldn't did didn't do does doesn't doing don't
down during each few for from further had hadn't has hasn't have haven't having he her here hers
herself him himself his how i if in into is isn't it it's its itself let's me more most mustn't my
myself no nor not of off on once only or other ought our ours ourselves out over own same shan't
she should shouldn't so some such than that that's the their theirs them themselves then there
there's these they this those through to too under until up very was wasn't we were weren't what
when where which while who whom why with won't would wouldn't you your yours yourself yourselves
also may might must shall will within without upon via per etc ie eg i.e e.g. respectively
using used one two three four five six seven eight nine ten first second third its whose
""".split()
INSTRUCTIONS = """
derive derivation explain define definition describe discuss calculate compute determine find obtain show prove state
write short note notes brief briefly neat sketch diagram figure suitable example examples mark marks what how why when
which give list differentiate distinguish compare comparison difference between mean meant illustrate elaborate evaluate
estimate draw following also using use help necessary assume data value values term terms expression relation relationship
significance importance important various type types applications application advantage advantages disadvantage
disadvantages answer question questions attempt any all given fig case cases detail details clearly properly
""".split()
UNITS = """
mm cm km m kg g mg s ms kpa mpa gpa pa n kn j kj mj w kw mw mol kmol l ml lit litre litres liter liters k
rpm hz khz v kv mv a ma ohm bar atm psi ft lb lbs hr hrs h min mins sec secs deg degc degf kmph kcal cal btu
ppm mmhg nm um
""".split()
#: Tokens end at an apostrophe, so what stands before it counts.
SKIPPED = tuple(dict.fromkeys(w.split("'")[0] for w in STOP_WORDS + INSTRUCTIONS + UNITS))
#: What symbols are spelled out as.
GREEK = dict(
    zip(
        "αβγδεϵζηθϑικλμµνξοπρσςτυφϕχψωΓΔΘΛΞΠΣΥΦΨΩ",
        "alpha beta gamma delta epsilon epsilon zeta eta theta theta iota kappa lambda mu mu nu xi omicron pi rho sigma sigma tau upsilon phi phi chi psi omega"
        " Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split(),
        strict=True,
    )
)
MATH_SYMBOLS = {
    "∫": "integral", "∬": "double integral", "∮": "contour integral", "∂": "partial", "∇": "nabla", "∑": "sum", "∏": "product", "√": "sqrt", "∞": "infinity",
    "≈": "approx", "≃": "approx", "≅": "approx", "≠": "!=", "≤": "<=", "≥": ">=", "±": "+/-", "∓": "-/+", "×": "x", "·": "*", "÷": "/", "∝": "proportional to",
    "→": "->", "⇒": "=>", "⟶": "->", "↔": "<->", "⇌": "<=>", "∈": "in", "∀": "for all", "∃": "exists", "°": "deg", "℃": "degC", "℉": "degF", "Å": "angstrom",
    "‰": "per mille", "∆": "Delta",
}
RAISED, RAISED_PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni"
LOWERED, LOWERED_PLAIN = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ", "0123456789+-=()aeoxhklmnpst"
FRACTIONS = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅛": "1/8"}
#: The seven formats, in the order in which a tie goes, and the pattern of each with its weight.
TYPE_PATTERNS = (
    ("definition", r"\b(define|what is meant by|state)\b", 1.2), ("derivation", r"\b(derive|prove|show that|deduce|establish)\b", 1.4),
    ("numerical", r"\b(calculate|find|compute|determine|estimate|how much|how many|obtain)\b", 1.1), ("diagram", r"\b(draw|sketch|diagram|plot)\b", 1.3),
    ("objective", r"\b(choose|select|tick|true or false|fill in)\b", 1.5), ("theory", r"\b(explain|describe|discuss|comment|compare|justify|why|how)\b", 1.0),
)
MONTHS = "baisakh jestha ashadh shrawan bhadra ashwin kartik mangsir poush magh falgun chaitra".split()
SEASONS = {"spring": 0.25, "summer": 0.5, "autumn": 0.75, "fall": 0.75, "winter": 0.95}


def clean_text(x: Column) -> Column:
    """Typographic marks to plain ones, invisible and control characters removed, tabs to four spaces, at most one blank
    line in a row."""
    x = F.translate(x, "‘’‚“”„–—−…     　", "'''\"\"\"---.      ")
    x = F.regexp_replace(x, "[​-‏⁠﻿­]", "")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.regexp_replace(x, "\t", "    "), r"[\x00-\x09\x0B-\x1F\x7F]", " ")
    return F.regexp_replace(x, r"\n[ ]*\n([ ]*\n)+", "\n\n")


def collapse_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_math(x: Column) -> Column:
    """Raised runs to ^..., lowered ones to _... (lowered digits after a letter or bracket to plain ones), fractions, Greek
    letters and operators spelled out, spaces between words single."""
    special = "".join([*FRACTIONS, *GREEK, *MATH_SYMBOLS]) + RAISED + LOWERED
    y = x
    for a, b in FRACTIONS.items():
        y = F.replace(y, F.lit(a), F.lit(b))
    # \x01 and \x02 mark lowered digits that become plain ones.
    y = F.regexp_replace(y, f"([A-Za-z)])([{LOWERED[:10]}]+)", "$1\x01$2\x02")
    y = F.regexp_replace(y, f"([{RAISED}]+)", "^$1")
    y = F.regexp_replace(y, f"(^|[^\x01{LOWERED}])([{LOWERED}]+)", "$1_$2")
    y = F.translate(y, RAISED + LOWERED + "\x01\x02", RAISED_PLAIN + LOWERED_PLAIN)
    for a, b in (GREEK | MATH_SYMBOLS).items():
        y = F.replace(y, F.lit(a), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(F.when(x.rlike(f"[{special}]"), y).otherwise(x), " {2,}", " "))


def normalize_for_matching(x: Column) -> Column:
    return F.lower(collapse_whitespace(normalize_math(clean_text(x))))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}][\p{L}\p{N}]*|[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def light_stem(w: Column) -> Column:
    """Suffixes off, for words long enough: the fallback where no stemmer is at hand."""
    return F.when(F.length(w) > 5, F.regexp_replace(w, r"(?:ations?|ings?|edly|ed|ies|es|s)$", "")).otherwise(w)


def content_terms(x: Column, stem: bool = True) -> Column:
    """Distinct tokens without stop words, instruction words, units, numbers and single letters, in order."""
    skip = F.array(*[F.lit(w) for w in SKIPPED])
    kept = F.filter(tokens(x), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]") & ~F.array_contains(skip, t))
    return F.array_distinct(F.transform(kept, light_stem) if stem else kept)


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\S+")).cast("long")


def implausible_token(t: Column) -> Column:
    """No vowel in four or more letters, five consonants in a row, a character four times, a digit inside a word, or
    capitals about a word. Tokens of up to three characters or without letters, abbreviations in capitals, formulas and
    units are plausible."""
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    fine = (F.length(t) < 4) | (letters == "") | (t.rlike(r"^[^\p{Ll}]{1,6}$") & t.rlike(r"\p{Lu}")) | t.rlike(r"^(?:[A-Z][a-z]?[0-9]*){1,4}$|^[a-z]{1,3}[0-9]$|^[0-9]+[a-zA-Z]{1,4}$")
    inner = F.substr(t, F.lit(2))
    capitals = (F.regexp_count(inner, F.lit("[A-Z]")) >= 2) & (F.regexp_count(inner, F.lit("[a-z]")) >= 2) & ~t.rlike(r"^[A-Z][a-z]+[A-Z][a-z]+$")
    noise = (~letters.rlike(r"(?i)[aeiouy]") & (F.length(letters) >= 4)) | t.rlike(r"(?i)[bcdfghjklmnpqrstvwxz]{5}") | t.rlike(r"(.)\1\1\1") | t.rlike(r"^[A-Za-z]+[0-9][A-Za-z]+$") | capitals
    return ~fine & noise


def garbage_ratio(x: Column) -> Column:
    """Share of characters, white space aside, that are no letter, digit or usual mark."""
    solid = F.length(F.regexp_replace(x, r"\s", ""))
    odd = F.length(F.regexp_replace(x, r"[\s\p{L}\p{M}\p{N}.,;:!?'\"()\[\]{}/%+=*<>&@#_-]", ""))
    return F.when(solid > 0, odd / solid).otherwise(0.0)


def unbalanced(x: Column) -> Column:
    n = lambda p: F.regexp_count(x, F.lit(p))
    return (F.abs(n(r"\(") - n(r"\)")) > 0) | (F.abs(n(r"\[") - n(r"\]")) > 0)


def broken_math(x: Column) -> Column:
    return x.rlike(r"[=+*/]\s*$|[=+*/]\s*[=*/]|^\s*[=*/]")


def text_flags(x: Column, confidence: Column | None = None) -> Column:
    """Flags of a text in a fixed order: empty, garbled, implausible, unbalanced, broken_equation, short, long, low_confidence."""
    words = F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9]{2,}"), F.lit(0))
    bad = F.when(F.size(words) > 0, F.size(F.filter(words, implausible_token)) / F.size(words)).otherwise(0.0)
    n = word_count(x)
    empty = F.coalesce(F.trim(x) == "", F.lit(True))
    flags = [
        F.when(empty, "empty"), F.when(~empty & (garbage_ratio(x) > 0.25), "garbled"), F.when(~empty & (bad > 0.30), "implausible"), F.when(~empty & unbalanced(x), "unbalanced"),
        F.when(~empty & broken_math(x), "broken_equation"), F.when(~empty & (n < 3), "short"), F.when(~empty & (n > 400), "long"),
    ]
    if confidence is not None:
        flags.append(F.when(confidence < 60, "low_confidence"))
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def marks_expression(x: Column) -> Column:
    """Value of marks such as 6, 2+4, 5x2 or 2x3+4; null for anything else."""
    ok = x.rlike(r"^\s*\d+(?:\.\d+)?(?:\s*[x×*+]\s*\d+(?:\.\d+)?)*\s*$")
    terms = F.split(F.translate(F.regexp_replace(x, r"\s", ""), "×*", "xx"), r"\+")
    product = lambda t: F.aggregate(F.split(t, "x"), F.lit(1.0), lambda a, v: a * v.cast("double"))
    return F.when(ok, F.aggregate(F.transform(terms, product), F.lit(0.0), lambda a, v: a + v))


def trailing_marks(x: Column) -> Column:
    """struct(marks, how): marks at the end of a question, in brackets, with the word, in parentheses, or in the margin."""
    expr = r"\d+(?:\.\d+)?(?:\s*[x×*+]\s*\d+)*"
    get = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    bracket, word = get(rf"\[\s*({expr})\s*\]\s*$"), get(rf"(?i)\(\s*({expr})\s*marks?\s*\)\s*$")
    loose, paren = get(rf"(?i)({expr})\s*marks?\s*$"), get(rf"\(\s*({expr})\s*\)\s*$")
    margin = get(r"\S {4,}(\d{1,2})\s*$")
    how = F.coalesce(F.when(bracket.isNotNull(), "bracket"), F.when(word.isNotNull(), "word in parentheses"), F.when(loose.isNotNull(), "word"), F.when(paren.isNotNull(), "parentheses"), F.when(margin.isNotNull(), "margin"))
    return F.struct(marks_expression(F.coalesce(bracket, word, loose, paren, margin)).alias("marks"), how.alias("how"))


def clean_question(x: Column) -> Column:
    """A question without its label and marks."""
    x = F.regexp_replace(collapse_whitespace(x), r"^\s*(?:Q\s*\d+\s*[:.)]|\(?\d{1,3}[.)]|\(?[a-hivx]{1,4}\))\s*", "")
    return F.trim(F.regexp_replace(x, r"\s*(?:\[\s*[\d+x×* ]+\s*\]|\(\s*\d+(?:\s*marks?)?\s*\))\s*$", ""))


def type_scores(x: Column, marks: Column | None = None) -> Column:
    """array of struct(score, order, type): weight times 1 + a quarter a further hit; numbers speak for numerical; without
    any hit a question is theory."""
    low = F.lower(x)
    hits = lambda p: F.regexp_count(low, F.lit(p))
    rows = []
    for i, (name, pattern, weight) in enumerate(TYPE_PATTERNS):
        score = F.when(hits(pattern) > 0, weight * (1 + 0.25 * (hits(pattern) - 1))).otherwise(0.0)
        if name == "numerical":
            score = score + F.when(low.rlike(r"\d+(?:\.\d+)?\s*(?:[kmg]?(?:pa|n|j|w|v|a|hz|m|mm|cm|kg|s|k|ohm|bar|rpm|litres|min|mol))\b"), 0.8).otherwise(0.0)
        rows.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("type")))
    return F.array(*rows)


def question_type(x: Column) -> Column:
    """struct(type, types, confidence): the best type, all types with at least half its score, min(1, top / 1.5)."""
    s = type_scores(x)
    best = F.array_max(s)
    top = best["score"]
    types = F.transform(F.filter(s, lambda r: (r["score"] > 0) & (r["score"] >= 0.5 * top)), lambda r: r["type"])
    return F.struct(F.when(top > 0, best["type"]).otherwise("theory").alias("type"), F.when(top > 0, types).otherwise(F.array(F.lit("theory"))).alias("types"), F.least(F.lit(1.0), top / 1.5).alias("confidence"))


LABEL_PATTERNS = {
    "define": r"\b(define|meaning of|meant by)\b", "state": r"\bstate\b", "explain": r"\b(explain|describe)\b", "compare": r"\b(compare|differ\w*|distinguish)\b", "derive": r"\b(derive|deduce|prove|show that)\b",
    "calculate": r"\b(calculate|compute|find|determine|obtain|estimate)\b", "draw": r"\b(draw|sketch|plot)\b", "list": r"\b(list|enumerate|name)\b", "justify": r"\b(justify|why|reason)\b", "check": r"\b(check|verify)\b",
    "design": r"\bdesign\b", "discuss": r"\b(discuss|comment)\b", "advantages": r"\b(advantages?|limitations?|merits?)\b", "short_note": r"\bshort notes?\b", "objective": r"\b(choose|true or false)\b", "predict": r"\bpredict\b",
}
FAMILIES = {
    "definition": ("define", "state"), "explanation": ("explain", "discuss", "justify"), "comparison": ("compare",), "derivation": ("derive",), "numerical": ("calculate", "check", "predict"),
    "diagram": ("draw",), "enumeration": ("list", "advantages"), "design": ("design",), "other": ("short_note", "objective"),
}


def format_labels(x: Column) -> Column:
    """All labels whose pattern the text has, in a fixed order."""
    low = F.lower(x)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in LABEL_PATTERNS.items()]), lambda v: v.isNotNull())


def families_of(labels: Column) -> Column:
    return F.filter(F.array(*[F.when(F.arrays_overlap(labels, F.array(*[F.lit(v) for v in m])), F.lit(n)) for n, m in FAMILIES.items()]), lambda v: v.isNotNull())


def year_of(x: Column) -> Column:
    """The first year from 1950 to 2099 that stands by itself; null without one."""
    return F.nullif(F.regexp_extract(x, r"(?<!\d)((?:19[5-9]|20\d)\d)(?!\d)", 1), F.lit("")).cast("int")


def session_of(x: Column) -> Column:
    low = F.lower(x)
    return F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in MONTHS], *[F.when(low.rlike(rf"\b{s}\b"), F.lit(s)) for s in SEASONS])


def exam_type_of(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.rlike(r"\b(re-?sit|back)\b"), "re-sit").when(low.rlike(r"\bregular\b"), "regular").when(low.rlike(r"\bmodel\b"), "model").when(low.rlike(r"\bfinal\b"), "final").when(low.rlike(r"\b(mid|internal)"), "internal")


def bs_to_ad(year: Column) -> Column:
    """Approximate common-era year of a Bikram Sambat year."""
    return year - F.lit(56.7)


def order_index(year: Column, calendar: Column, session: Column, exam_type: Column) -> Column:
    """Place of an exam in time: its year, the part of it that the session stands for, a little more for a re-sit; 0
    without a year; four places."""
    base = F.when(calendar == "BS", bs_to_ad(year)).otherwise(year.cast("double"))
    month = F.coalesce(*[F.when(session == m, F.lit((i + 0.5) / 12)) for i, m in enumerate(MONTHS)], *[F.when(session == s, F.lit(v)) for s, v in SEASONS.items()], F.lit(0.5))
    part = F.least(F.greatest(month, F.lit(0.0)), F.lit(0.99)) * 0.98 + F.when(exam_type == "re-sit", 0.01).otherwise(0.0)
    return F.when(year.isNull(), 0.0).otherwise(F.round(base + part, 4))


def hours_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?i)(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)\b", 1), F.lit("")).cast("double")


def roman_or_int(x: Column) -> Column:
    """Value of a number or a Roman numeral up to xxxix."""
    u = F.upper(x)
    tens = F.length(F.regexp_extract(u, r"^(X{0,3})", 1)) * 10
    ones = F.element_at(F.create_map(*[F.lit(v) for p in zip(["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], range(10), strict=True) for v in p]), F.regexp_replace(u, r"^X{0,3}", ""))
    return F.when(x.rlike(r"^\d+$"), x.try_cast("int")).when(u.rlike(r"^X{0,3}(?:IX|IV|V?I{0,3})$") & (x != ""), (tens + ones).cast("int"))


def line_kind(line: Column) -> Column:
    """Kind of an exam paper's line, the first that fits: or, section, instruction, marks, main_sub, dotted, main, roman, letter, text."""
    t = F.trim(line)
    return (
        F.when(t.rlike(r"(?i)^\(?or\)?$"), "or").when(t.rlike(r"(?i)^(section|group|part)\s+[\"']?[a-z0-9]\b"), "section").when(t.rlike(r"(?i)^(attempt|answer|instructions?|candidates)\b"), "instruction")
        .when(t.rlike(r"^\[?\s*\d+(?:\s*[x×+]\s*\d+)*\s*\]?$"), "marks").when(t.rlike(r"^\d{1,2}[.)]?\s*\([a-z]\)"), "main_sub").when(t.rlike(r"^\d+(?:\.\d+)+\.?\s"), "dotted")
        .when(t.rlike(r"^(?:Q\s*)?\(?\d{1,3}[.):]\)?\s"), "main").when(t.rlike(r"^\(?[ivx]+[.)]\s"), "roman").when(t.rlike(r"^\(?[a-zA-Z][.)]\s"), "letter").otherwise("text")
    )


def wrapped_lines_joined(text: Column) -> Column:
    """A text whose lines that start in lower case are joined to the line before."""
    return F.regexp_replace(text, r"[ ]*\n[ ]*(?=\p{Ll})", " ")
