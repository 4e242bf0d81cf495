"""Languages of documents, of their lines and of stretches of lines, by cross-parsing against labelled text.

Running labelled text of each language becomes a suffix automaton. A line is parsed greedily into phrases, each the longest
match of what is left with any stretch of the labelled text, across its words; a phrase costs the logarithm of the text's
length, for that is what it takes to name it. The language with the least cost for the line's length wins. Where a stretch
of words speaks for another language than the rest of its line, the line is divided.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.functions.numerics import golden_section

#: Bounds of the labelled sample a language: documents, code points of a document, lines drawn from them (on average), letters
#: and spaces of clean lines that the automaton holds. Lines beyond those are kept aside for the calibration.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_LINES, SAMPLE_TEXT = 1500, 20_000, 2500, 40_000
#: Of the words of a line of labelled text, this share of what they say must be for its label: labels are partly wrong.
CLEAN = 0.4
#: Lines are parsed in stretches of so many words, so that a line without end is many rows of a matrix.
STRETCH = 64
#: Odds (as a logarithm) at which a stretch of a line counts as of another language, and the words it must have.
SWITCH, LEAST_WORDS = 6.0, 4

def words_of(line: Column) -> Column:
    """Words of a line in lower case: runs of letters and their marks."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))


def lines_of(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """key, line_no, line, keep: the lines that aren't blank, numbered from 1. Null texts have none."""
    parts = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\p{IsWhite_Space}\p{Cc}]"))
    return df.select(key, *keep, F.posexplode(parts).alias("_pos", "line")).select(key, (F.col("_pos") + 1).cast("int").alias("line_no"), "line", *keep)


def plain(word: str) -> str:
    """Without the accents of Latin letters: texts lose them on the way, and all languages are compared without."""
    return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", word))


class Automaton:
    """Suffix automaton of a text as edges: from state, by symbol, to state; state 1 is the start."""

    def __init__(self, text: str, symbols: dict[str, int]) -> None:
        nxt: list[dict[int, int]] = [{}, {}]
        link, size, last = [0, 0], [0, 0], 1
        for ch in text:
            c = symbols[ch]
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(1)
            p = last
            while p and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p:
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = twin
                    while p and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
            last = cur
        self.states, self.symbols, self.length = len(nxt), len(symbols) + 1, len(text)
        edges = [(s, c, t) for s, row in enumerate(nxt) for c, t in row.items()]
        self.edges = np.array(edges, np.int64).reshape(-1, 3)

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of padded rows of symbols (0: none of the labelled text's): phrases of the greedy longest-match parse."""
        return Parser([self]).starts(codes, sizes).sum(1)[:, 0]


class Parser:
    """The automata of all languages in one table of edges without gaps to speak of.

    A state is named by a place in the table, chosen so that its edge by symbol c stands c places further and collides with
    no other state's; an edge holds the state that it belongs to and the one that it leads to. So a step is one look-up.
    State 0 has no edges.
    """

    def __init__(self, automata: list[Automaton]) -> None:
        self.n_symbols = max((a.symbols for a in automata), default=1)
        rows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for k, a in enumerate(automata):
            for s, c, t in a.edges.tolist():
                rows[k, s].append((c, t))
        total, width = sum(map(len, rows.values())), self.n_symbols + 1
        taken, named = bytearray(2 * total + 4 * width), bytearray(2 * total + 4 * width)
        place: dict[tuple[int, int], int] = {}
        low = width  # nearly all places before it are taken

        def put(state: tuple[int, int], at: int) -> None:
            place[state] = at
            named[at] = 1
            for c, _ in rows[state]:
                taken[at + c] = 1

        many = sorted((x for x in rows if len(rows[x]) > 1), key=lambda x: (-len(rows[x]), x))
        for state in many:  # those with several edges go where they first fit
            symbols, tries = [c for c, _ in rows[state]], 0
            at = low - symbols[0]
            while named[at] or any(taken[at + c] for c in symbols):
                at, tries = at + 1, tries + 1
            put(state, at)
            low += tries // 16
            if at + 4 * width > len(taken):
                taken, named = taken + bytes(len(taken)), named + bytes(len(named))
        at = width
        for state in (x for x in rows if len(rows[x]) == 1):  # those with one fill the gaps
            c = rows[state][0][0]
            while taken[at] or named[at - c]:
                at += 1
            put(state, at - c)
            if at + 4 * width > len(taken):
                taken, named = taken + bytes(len(taken)), named + bytes(len(named))
        size = max([p + width for p in place.values()], default=width) + width
        self.edges = np.zeros(size, np.uint64)
        self.root = np.zeros((self.n_symbols, len(automata)), np.int64)
        end = size - width  # states without an edge
        for state, edges in rows.items():
            at = place[state]
            for c, t in edges:
                to = place.get((state[0], t), end)
                self.edges[at + c] = at << 32 | to
                if state[1] == 1:
                    self.root[c, state[0]] = to

    def starts(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of padded rows of symbols: whether a phrase starts at each place, in each language (row, place, language)."""
        rows, width = codes.shape
        out = np.zeros((width, rows, self.root.shape[1]), bool)
        for j, fail in enumerate(self._steps(codes.ravel(), np.arange(rows) * width, width)):
            out[j] = fail
        return out.transpose(1, 0, 2) & (np.arange(width)[None, :] < sizes[:, None])[:, :, None]

    def _steps(self, code: np.ndarray, begin: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """Rows that begin at places of code, read together symbol by symbol."""
        state, low, high = np.zeros((len(begin), self.root.shape[1]), np.int64), np.uint64(0xFFFFFFFF), np.uint64(32)
        for j in range(width):
            c = code[begin + j]
            edge = self.edges[state + c[:, None]]
            fail = (edge >> high).view(np.int64) != state
            fail |= edge == 0
            # A symbol that never occurs is a phrase by itself.
            state = np.where(fail, self.root[c], (edge & low).view(np.int64))
            yield fail

    def counts(self, code: np.ndarray, begin: np.ndarray, width: int, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Phrases begun up to each word end (its place and row; sorted by place), in each language."""
        out = np.zeros((len(ends), self.root.shape[1]), np.int32)
        seen, slices = np.zeros((len(begin), self.root.shape[1]), np.int32), np.searchsorted(ends, np.arange(width + 1)).tolist()
        for j, fail in enumerate(self._steps(code, begin, width)):
            seen += fail
            a, b = slices[j], slices[j + 1]
            if b > a:
                out[a:b] = seen[row[a:b]]
        return out


def _table(symbols: dict[str, int]) -> np.ndarray:
    """The symbol of every code point: that of its plain form; -1 for the accents of Latin letters, 0 for what is unknown."""
    out = np.zeros(0x110000, np.int16)
    for ch, i in symbols.items():
        out[ord(ch)] = i
    for cp in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        if chr(cp) not in symbols and len(d := plain(chr(cp))) == 1:
            out[cp] = symbols.get(d, 0)
    out[0x300:0x370] = -1
    return out


@dataclass
class Model:
    """steepness: how many nats of odds a nat of cost is worth, fitted on lines kept aside."""

    languages: list[str]
    symbols: dict[str, int]
    parser: Parser
    weights: np.ndarray
    steepness: float = 1.0

    def __post_init__(self) -> None:
        self.table = _table(self.symbols)

    def costs(self, lines: list[list[str]]) -> np.ndarray:
        """costs_of() of lines given as words."""
        return self.costs_of(["".join(w + " " for w in x) for x in lines])[0]

    def costs_of(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs in nats of every word of all lines, in each language, in a row; the numbers of words and of characters of
        the lines. In a line, every word is followed by a space. A word pays for the phrases that start in it or in that
        space. Lines are parsed in stretches of STRETCH words."""
        k = len(self.languages)
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.table[points]
        line = np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))
        keep = code >= 0
        code, line, space = code[keep].astype(np.int64), line[keep], points[keep] == 32
        chars = np.bincount(line, minlength=len(lines))
        stop = np.flatnonzero(space)
        n = np.bincount(line[stop], minlength=len(lines))
        out = np.zeros((len(stop), k))
        if not len(stop):
            return out, n, chars
        nth = np.arange(len(stop)) - np.repeat(np.cumsum(n) - n, n)
        first = np.flatnonzero(nth % STRETCH == 0)  # first words of stretches
        begin = np.concatenate([[0], stop[:-1] + 1])[first]
        size = np.concatenate([begin[1:], [len(code)]]) - begin
        words = np.diff(np.concatenate([first, [len(stop)]]))
        order = np.argsort(size, kind="stable")
        code = np.concatenate([code, np.zeros(int(size.max()), np.int64)])  # rows of a bucket are read to the width of its longest
        at = 0
        while at < len(order):
            rows = order[at : at + 4096]
            at += len(rows)
            width = int(size[rows].max())
            row = np.repeat(np.arange(len(rows)), words[rows])
            word = np.arange(len(row)) - np.repeat(np.cumsum(words[rows]) - words[rows], words[rows]) + first[rows][row]
            place = stop[word] - begin[rows][row]
            by = np.argsort(place, kind="stable")
            upto = np.zeros((len(row), k), np.int64)
            upto[by] = self.parser.counts(code, begin[rows], width, place[by], row[by])
            upto[1:] -= np.where((row[1:] == row[:-1])[:, None], upto[:-1], 0)
            out[word] = upto
        return out * self.weights, n, chars

    def divided(self, cost: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, words, language) of the stretches of a line, from the costs of its words: the cheapest division, if
        each change of language costs SWITCH."""
        c = self.steepness * cost
        n, k = c.shape
        best, back = c[0].copy(), np.zeros((n, k), np.int64)
        for i in range(1, n):
            low = int(best.argmin())
            jump = best[low] + SWITCH < best
            back[i] = np.where(jump, low, np.arange(k))
            best = np.where(jump, best[low] + SWITCH, best) + c[i]
        path = np.empty(n, np.int64)
        path[-1] = int(best.argmin())
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i][path[i]]
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), n]
        return [(a, b - a, int(path[a])) for a, b in zip(cuts, cuts[1:], strict=False)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """Automata of the languages of labels (label, lang), from a bounded sample of the labelled documents of docs.

    Labels are partly wrong, so the sample is cleaned first: a word speaks for a language by its rate under the language's
    label among its rates under all labels, and a line is labelled text if its words speak for its label. In the order of a
    hash, one line in five and all beyond SAMPLE_TEXT are kept aside to fit the steepness.
    """
    codes = {r[0]: r[1] for r in labels.select("label", "lang").where("label is not null and lang is not null").collect()}
    languages = sorted(set(codes.values()))
    meant = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col(label)] if codes else F.lit(None).cast("string")
    known = docs.where(F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(F.col(key).alias("_key"), F.col(text).alias("_text"), meant.alias("_lang")).where("_lang is not null")
    there = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    share = F.coalesce(*[F.when(F.col("_lang") == x, F.lit(min(1.0, SAMPLE_DOCUMENTS / n))) for x, n in there.items()], F.lit(1.0)) if there else F.lit(1.0)
    drawn = F.pmod(F.xxhash64(F.col("_key"), F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)
    lines = lines_of(known.where(drawn), "_key", "_text", "_lang").select("_lang", "line", F.xxhash64("_key", "line_no").alias("_h"))
    per = {r["_lang"]: r["count"] for r in lines.groupBy("_lang").count().collect()}
    share = F.coalesce(*[F.when(F.col("_lang") == x, F.lit(min(1.0, SAMPLE_LINES / n))) for x, n in per.items()], F.lit(1.0)) if per else F.lit(1.0)
    some = lines.where(F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) < share * (1 << 30)).select("_lang", "_h", words_of(F.col("line")).alias("_words")).where("size(_words) >= 3")
    sample = sorted((r["_h"], r["_lang"], [plain(w) for w in r["_words"]]) for r in some.collect())  # about SAMPLE_LINES a language
    rates: dict[str, Counter] = defaultdict(Counter)
    for _, x, words in sample:
        rates[x].update(words)
    total = {x: c.total() for x, c in rates.items()}
    everywhere: Counter = Counter()
    for x, c in rates.items():
        for w, n in c.items():
            everywhere[w] += n / total[x]
    texts, sizes, aside, held = defaultdict(list), Counter(), Counter(), []
    for _, x, words in sample:
        if sum(rates[x][w] / total[x] / everywhere[w] for w in words) < CLEAN * len(words):
            continue
        if sizes[x] < SAMPLE_TEXT and len(texts[x]) < 4 * aside[x] + 4:
            texts[x].append(" ".join(words))
            sizes[x] += len(texts[x][-1]) + 1
        else:
            held.append((x, words))
            aside[x] += 1
    return _model(languages, {x: " " + " ".join(texts[x])[:SAMPLE_TEXT] + " " for x in languages}, held)


def _model(languages: list[str], texts: dict[str, str], held: list[tuple[str, list[str]]]) -> Model:
    """Automata of the texts, and the steepness that makes short pieces of the held lines most likely."""
    symbols = {ch: i for i, ch in enumerate(sorted(set("".join(texts.values()))), 1)}
    automata = [Automaton(texts[x], symbols) for x in languages]
    model = Model(languages, symbols, Parser(automata), np.array([math.log(a.length + 1) for a in automata]))
    pieces = [(x, w[i : i + 1 + n % 5]) for n, (x, w) in enumerate(held) for i in range(0, len(w), 6)]
    if not pieces or len(languages) < 2:
        return model
    sizes = np.fromiter((len(w) for _, w in pieces), np.int64, len(pieces))
    cost = np.add.reduceat(model.costs([w for _, w in pieces]), np.cumsum(sizes) - sizes, axis=0)
    truth = np.fromiter((languages.index(x) for x, _ in pieces), np.int64, len(pieces))
    gap = cost - cost[np.arange(len(cost)), truth][:, None]
    loss = lambda s: float(np.logaddexp.reduce(-math.exp(s) * gap, axis=1).mean())
    model.steepness = math.exp(golden_section(loss, math.log(0.02), math.log(2.0)))
    return model


def _scored(model: Model, key: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost, n, chars = model.costs_of(b.column("_words").to_pylist())
            ends = np.cumsum(n)
            upto = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, 0)])
            whole = upto[ends] - upto[ends - n]
            best = whole.argmin(1) if len(whole) else np.empty(0, np.int64)
            odds = np.exp(-model.steepness * (whole - whole.min(1, keepdims=True))) if len(whole) else whole
            sure = 1 / odds.sum(1)
            # Only lines with a stretch of words that speaks against the line's language are divided.
            gain = cost[np.arange(len(cost)), np.repeat(best, n)][:, None] - cost
            run_of = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(gain, 0)])
            split = np.zeros(len(n), bool)
            if len(cost):
                wide = np.minimum(np.arange(len(cost)) + LEAST_WORDS, np.repeat(ends, n))
                split[np.repeat(np.arange(len(n)), n)[model.steepness * (run_of[wide] - run_of[:-1]).max(1) > SWITCH]] = True
            pieces, langs, conf = [], [], []
            for i, words_in in enumerate(n.tolist()):
                parts = model.divided(cost[ends[i] - words_in : ends[i]]) if split[i] else [(0, words_in, int(best[i]))] if words_in else []
                if len(parts) > 1:
                    rows = []
                    for first, m, lang in parts:
                        c = upto[ends[i] - words_in + first + m] - upto[ends[i] - words_in + first]
                        rows.append({"first_word": first + 1, "n_words": m, "lang": model.languages[lang], "confidence": float(1 / np.exp(-model.steepness * (c - c[lang])).sum())})
                    # The line's language is that of most of its words.
                    most = Counter()
                    for r in rows:
                        most[r["lang"]] += r["n_words"]
                    top = max(sorted(most), key=most.__getitem__)
                    langs.append(top)
                    conf.append(sum(r["confidence"] * r["n_words"] for r in rows if r["lang"] == top) / most[top])
                else:
                    langs.append(model.languages[parts[0][2]] if parts else None)
                    conf.append(float(sure[i]) if parts else None)
                    rows = [{"first_word": 1, "n_words": words_in, "lang": langs[-1], "confidence": conf[-1]}] if parts else []
                pieces.append(rows)
            per = whole / np.maximum(chars, 1)[:, None] / math.log(2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(per) + 1, dtype=np.int32) * len(model.languages)), pa.array(per.ravel()))
            shape = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
            names = [key, "line_no", *keep, "n_words", "costs", "lang", "confidence", "pieces"]
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("line_no"), *[b.column(c) for c in keep], pa.array(n.astype(np.int32)), lists, pa.array(langs, pa.string()), pa.array(conf, pa.float64()), pa.array(pieces, shape)], names=names
            )

    return run


def line_languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, line_no, keep, n_words, costs, lang, confidence, pieces of every line that isn't blank.

    costs: the cross-parsing entropy in each of model.languages, in bits a character. pieces (first_word, n_words, lang,
    confidence): the line's stretches of one language, most often one. lang is that of most of its words. A line without a
    word has null lang and confidence and no pieces; ties go to the first language by name, with a confidence of at most a
    half.
    """
    keep = keep or []
    kinds = dict(docs.dtypes)
    rows = lines_of(docs, key, text, *keep).select(key, "line_no", *keep, F.array_join(F.transform(words_of(F.col("line")), lambda w: F.concat(w, F.lit(" "))), "").alias("_words"))
    shape = ", ".join([f"`{key}` {kinds[key]}", "line_no int", *[f"`{c}` {kinds[c]}" for c in keep], "n_words int", "costs array<double>", "lang string", "confidence double", "pieces array<struct<first_word:int,n_words:int,lang:string,confidence:double>>"])
    return rows.mapInArrow(_scored(model, key, keep), shape)


def wrong_lines(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: Model | None = None) -> DataFrame:
    """key, line_no, lang of each line whose language isn't the one that the document's label means.

    A label that is null or unknown means no language. Lines without a word have no language and aren't listed; null and
    empty texts have no lines. Repeated rows count once.
    """
    model = model or fit(docs, labels, text, label, key)
    codes = labels.where("label is not null").groupBy("label").agg(F.min("lang").alias("_meant"))
    named = docs.select(key, text, F.col(label).alias("_label"))
    found = line_languages(_meaning(named, codes, key, text), model, key, text, ["_meant"])
    return found.where("lang is not null and not (lang <=> _meant)").select(key, "line_no", "lang")


def _meaning(named: DataFrame, codes: DataFrame, key: str, text: str) -> DataFrame:
    """The label's language beside each text; Spark broadcasts the codes if they are as small as they ought to be."""
    return named.join(codes, named["_label"] == codes["label"], "left").select(key, text, "_meant")


def segments(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, segment, first_line, first_word, last_line, last_word, lang, confidence: stretches of one language, numbered
    from 1; they may begin and end inside a line. Words are numbered from 1 in their line.

    Lines without a language belong to the stretch before them, at the start of a document to the one after.
    """
    each = lines.select(key, "line_no", F.explode_outer("pieces").alias("p")).select(key, "line_no", F.coalesce("p.first_word", F.lit(1)).alias("word"), F.coalesce("p.n_words", F.lit(0)).alias("n_words"), "p.confidence", "p.lang")
    w = W.partitionBy(key).orderBy("line_no", "word")
    filled = each.select(key, "line_no", "word", "n_words", "confidence", F.coalesce(F.last("lang", True).over(w), F.first("lang", True).over(w.rowsBetween(0, W.unboundedFollowing))).alias("lang"))
    turned = filled.withColumn("_turn", F.when(F.col("lang").eqNullSafe(F.lag("lang").over(w)) & (F.lag("line_no").over(w).isNotNull()), 0).otherwise(1))
    numbered = turned.withColumn("segment", F.sum("_turn").over(w).cast("int"))
    weight = F.sum(F.coalesce("confidence", F.lit(0.0)) * F.col("n_words")) / F.sum(F.when(F.col("confidence").isNotNull(), F.col("n_words")))
    ends = numbered.groupBy(key, "segment", "lang").agg(F.min(F.struct("line_no", "word")).alias("a"), F.max(F.struct("line_no", (F.col("word") + F.greatest("n_words", F.lit(1)) - 1).alias("word"))).alias("b"), F.round(weight, 6).alias("confidence"))
    return ends.select(key, "segment", F.col("a.line_no").alias("first_line"), F.col("a.word").alias("first_word"), F.col("b.line_no").alias("last_line"), F.col("b.word").alias("last_word"), "lang", "confidence")


def document_languages(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: Model | None = None) -> DataFrame:
    """key, label_lang, lang, confidence, mixed, label_ok of each document.

    lang: the language of most words, by the pieces' languages, confidence their share weighted by the pieces' confidence;
    null without any word. mixed: pieces of more than one language. label_ok: the label means that language.
    """
    model = model or fit(docs, labels, text, label, key)
    codes = labels.where("label is not null").groupBy("label").agg(F.min("lang").alias("_meant"))
    per = line_languages(docs.select(key, text), model, key, text).select(key, F.explode("pieces").alias("p")).select(key, "p.n_words", "p.lang", "p.confidence").groupBy(key, "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    best = per.groupBy(key).agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max_by("c", F.struct("n", "lang")).alias("_c"), F.sum("n").alias("_n"), (F.count("*") > 1).alias("mixed"))
    best = best.select(F.col(key).alias("_bkey"), F.col("lang").alias("_blang"), F.round(F.col("_c") / F.col("_n"), 6).alias("confidence"), "mixed")
    named = docs.select(key, F.col(label).alias("_label"))
    named = named.join(codes, named["_label"] == codes["label"], "left").select(key, "_meant")
    return named.join(best, named[key] == best["_bkey"], "left").select(
        key, F.col("_meant").alias("label_lang"), F.col("_blang").alias("lang"), "confidence", F.coalesce("mixed", F.lit(False)).alias("mixed"),
        (F.coalesce(F.col("_meant") == F.col("_blang"), F.lit(False))).alias("label_ok"),
    )
