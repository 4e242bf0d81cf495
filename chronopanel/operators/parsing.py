"""Papers and syllabuses from text lines: question trees with marks, topic trees with hours and concepts.

Line kinds are column expressions (functions.text.line_kind); what depends on the lines before runs as one pass over the
lines of a file in applyInPandas, files being the parallel axis.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.text import line_kind

QUESTION = "file_id long, q_no int, parent_no int, label string, depth int, section string, or_group int, is_optional boolean, marks double, marks_from string, text string"
_MARK = re.compile(r"\s*[\[(]\s*(\d+(?:\.\d+)?(?:\s*[x×*+]\s*\d+)*)\s*(?:marks?)?\s*[\])]\s*$", re.I)
_LABEL = re.compile(r"^\s*(?:Q\s*)?\(?(\d{1,3}|[ivx]{1,5}|[a-zA-Z])[.):]+\)?\s*(.*)$")


def marks_value(expr: str) -> float:
    """2+4 = 6, 5x2 = 10, 2x3+4 = 10."""
    total = 0.0
    for term in re.sub(r"[\s]", "", expr).replace("×", "x").replace("*", "x").split("+"):
        product = 1.0
        for factor in term.split("x"):
            product *= float(factor)
        total += product
    return total


def split_labels(text: str) -> list[tuple[str, str]]:
    """Parts "(i) ... (ii) ..." or "(a) ... (b) ..." of a text whose labels follow each other; else the whole text."""
    for series in ([f"({c})" for c in "abcdefgh"], ["(i)", "(ii)", "(iii)", "(iv)", "(v)", "(vi)"]):
        places, at = [], 0
        for s in series:
            at = text.find(s, at)
            if at < 0:
                break
            places.append((at, s))
            at += len(s)
        if len(places) > 1:
            ends = [p for p, _ in places[1:]] + [len(text)]
            return [(s.strip("()"), text[p + len(s) : e].strip()) for (p, s), e in zip(places, ends, strict=True)]
    return [("", text)]


def parse_paper(lines: list[tuple[str, str]]) -> list[dict]:
    """Questions of one paper from (kind, line): main questions by number, parts by letter or numeral below the last main
    one, or-groups by OR lines, sections by their headings; marks at a line's end belong to the question that it ends."""
    out: list[dict] = []
    section, pending_or, group, main, expected = None, False, 0, None, 1
    current: dict | None = None
    optional = False

    def add(label: str, text: str, parent: dict | None) -> dict:
        nonlocal pending_or, group
        q = {"q_no": len(out) + 1, "parent_no": parent["q_no"] if parent else None, "label": label, "depth": 1 + (parent["depth"] if parent else 0), "section": section, "or_group": None, "is_optional": optional, "marks": None, "marks_from": None, "text": text}
        if pending_or:
            last = next((x for x in reversed(out) if x["depth"] == q["depth"]), None)
            if last is not None:
                if last["or_group"] is None:
                    group += 1
                    last["or_group"] = group
                q["or_group"] = last["or_group"]
                last["is_optional"] = q["is_optional"] = True
            pending_or = False
        out.append(q)
        return q

    for kind, line in lines:
        text = line.strip()
        if not text:
            continue
        if kind == "or":
            pending_or = True
            continue
        if kind == "section":
            section, optional = text, bool(re.search(r"(?i)\bany\b", text))
            continue
        if kind == "instruction":
            optional = bool(re.search(r"(?i)\bany\b", text))
            continue
        if kind == "marks" and current is not None:
            current["marks"], current["marks_from"] = marks_value(re.sub(r"[\[\]\s]", "", text)), "line"
            continue
        m = _LABEL.match(text)
        if kind in ("main", "dotted", "main_sub") and m and m[1].isdigit() and (int(m[1]) == expected or expected <= int(m[1]) <= expected + 3 or main is None):
            main = current = add(m[1], m[2], None)
            expected = int(m[1]) + 1
        elif kind in ("letter", "roman") and m and main is not None:
            parent = main if kind == "letter" or current is main or current["depth"] == 1 else next((x for x in reversed(out) if x["depth"] == 2), main) if current["label"].isalpha() and not re.fullmatch(r"[ivx]+", current["label"]) else main
            current = add(m[1], m[2], parent)
        elif current is not None:
            current["text"] = (current["text"] + " " + text).strip()
        else:
            continue
        found = _MARK.search(current["text"])
        if found:
            current["marks"], current["marks_from"] = marks_value(found[1]), "bracket"
            current["text"] = current["text"][: found.start()].strip()
    # Marks of a question with parts: the sum of the parts' where it has none; shared out where the parts have none.
    for q in out:
        kids = [x for x in out if x["parent_no"] == q["q_no"]]
        if kids and q["marks"] is None and all(x["marks"] is not None for x in kids):
            q["marks"], q["marks_from"] = sum(x["marks"] for x in kids), "sum of parts"
        elif kids and q["marks"] is not None and all(x["marks"] is None for x in kids):
            for x in kids:
                x["marks"], x["marks_from"] = q["marks"] / len(kids), "share"
    return out


def paper_lines(pages: DataFrame) -> DataFrame:
    """file_id, page_no, pos, kind, line of all lines of pages (file_id, page_no, text)."""
    x = pages.where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).select("file_id", "page_no", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return x.select("file_id", "page_no", "pos", line_kind(F.col("line")).alias("kind"), "line")


def parse_papers(pages: DataFrame) -> DataFrame:
    """One row a question of each file; lines before the first question are its header. Files without one have no rows."""

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["page_no", "pos"])
        rows = parse_paper(list(zip(g["kind"], g["line"], strict=True)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in QUESTION.split(", ")[1:]])
        out.insert(0, "file_id", key[0])
        return out

    return paper_lines(pages).groupBy("file_id").applyInPandas(run, QUESTION)


def split_concepts(text: str) -> list[str]:
    """Concepts between commas and semicolons outside parentheses; a final "and" parts two, too."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch in "([") - (ch in ")]")
        if ch in ",;" and depth <= 0:
            out.append(part)
            part = ""
        else:
            part += ch
    out.append(part)
    if out and (m := re.match(r"^\s*(?:and\s+)?(.+)$", out[-1])) and len(out) > 1:
        out[-1] = m[1]
        if " and " in out[-1]:
            out[-1:] = out[-1].split(" and ", 1)
    return [x.strip(" .") for x in out if x.strip(" .")]


def parse_syllabus(pages: DataFrame) -> DataFrame:
    """file_id, node_no, parent_no, depth, number, title, concepts, hours of numbered headings ("1.2 Title: a, b (3 hours)")."""
    shape = "file_id long, node_no int, parent_no int, depth int, number string, title string, concepts array<string>, hours double"

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["page_no", "pos"])
        rows, at = [], {}
        for line in g["line"]:
            m = re.match(r"^\s*(?:Unit\s+)?(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$", line)
            if not m:
                continue
            number, rest = m[1], m[2].strip()
            hours = re.search(r"(?i)\(?(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)\)?", rest)
            title, _, tail = re.sub(r"(?i)\s*\(?\d+(?:\.\d+)?\s*(?:hours?|hrs?)\)?", "", rest).partition(":")
            parent = at.get(number.rpartition(".")[0])
            at[number] = len(rows) + 1
            rows.append((key[0], len(rows) + 1, parent, number.count(".") + 1, number, title.strip(" .;,"), split_concepts(tail), float(hours[1]) if hours else None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in re.sub("<.*?>", "", shape).split(", ")])

    x = pages.where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).select("file_id", "page_no", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Only headings go to Python.
    x = x.where(F.col("line").rlike(r"^\s*(?:Unit\s+)?\d+(?:\.\d+)*[.)]?\s+\S"))
    return x.groupBy("file_id").applyInPandas(run, shape)


def split_sequential(questions: DataFrame, key: str = "question_id", text: str = "text") -> DataFrame:
    """key, part, label, text of questions with sequential labels inside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, i, lab, t) for q, x in zip(b[key], b[text], strict=True) for i, (lab, t) in enumerate(split_labels(x or ""), 1)]
            yield pd.DataFrame(rows, columns=[key, "part", "label", "text"])

    return questions.select(key, text).mapInPandas(run, f"`{key}` long, part int, label string, text string")


_EQ = re.compile(r"(?<![A-Za-z])(?:[A-Za-zΑ-ωΔ]{1,3}|\d+(?:\.\d+)?|[()²³^_])(?: *(?:[=+×*/^−≈<>≤≥]) *(?:[A-Za-zΑ-ωΔ]{1,3}(?![A-Za-z])|\d+(?:\.\d+)?|[()²³])(?: ?[²³])?)+")


def equations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, equation: the longest runs of symbols, numbers and operators with an operator in them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, m[0].strip()) for k, x in zip(b[key], b[text], strict=True) for i, m in enumerate(_EQ.finditer(x or ""), 1)]
            yield pd.DataFrame(rows, columns=[key, "pos", "equation"])

    return texts.where(F.col(text).rlike("[=≈<>≤≥]")).select(key, text).mapInPandas(run, f"`{key}` long, pos int, equation string")
