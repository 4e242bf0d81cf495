"""Statistics of pages and what they hold: prose, a list, a table or junk."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import boosting
from chronopanel.llm.pages import page_furniture, page_lines
from chronopanel.sources.tables import cut

KINDS = ("prose", "list", "table", "junk")
#: Pages of the bounded sample that the trees are trained on.
SAMPLE = 3000
#: Mean log probability of letter pairs below which strings are no words of the corpus's languages.
STRANGE = -3.0
# The most common words of the languages at hand.
COMMON = (
    "the a an of and to in is that for it as with by on are was be this which not has have from or at its between each there when such into"
    " der die das und ist nicht ein eine zu den von mit für auf im dass wird sich bei aus dem werden sind wenn nur des"
    " le la les et est une que dans pour sur par du des pas ne au qui se sont avec plus peut cette ce un"
    " el los las y en del se por con para al es su lo como sin si puede entre una más"
    " o os e um uma não da do na no com ao pela pelo são seu sua mas ou em"
    " र को मा छ हुन्छ यो का ले लाई छन् गर्छ पनि भयो भने यदि थाहा तर"
).split()


def _letters(lines: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all lines (a to z, other letters, the rest 0) and the line of each."""
    codes = np.frombuffer(("\n".join(lines) + "\n").lower().encode("utf-32-le", "replace"), np.uint32)
    kind = np.where((codes >= 97) & (codes <= 122), codes - 96, np.where((codes >= 0xC0) & (codes < 0x2000) & (codes != 0xD7) & (codes != 0xF7), 27, 0)).astype(np.int64)
    return kind, np.concatenate([[0], np.cumsum(codes == 10)[:-1]])


def letter_pairs(lines: DataFrame) -> np.ndarray:
    """Log probabilities of the next class of character, over all lines: 28 x 28, whatever the corpus.

    They are of the square roots of the counts, so that a corpus's main language doesn't make its others look strange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(28 * 28, np.int64)
        for b in batches:
            kind, _ = _letters(b["line"])
            total += np.bincount(kind[:-1] * 28 + kind[1:], minlength=28 * 28)
        yield pd.DataFrame({"pair": np.arange(28 * 28), "n": total})

    counts = np.ones((28, 28))
    for r in lines.select("line").mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[divmod(r["pair"], 28)] += r["n"]
    counts = np.sqrt(counts)
    return np.log(counts / counts.sum(1, keepdims=True))


#: Tokens that a worker remembers.
REMEMBERED = 500_000
#: What is counted in every token, in this order.
TOKEN_COUNTS = ("words", "letters", "digits", "symbols", "odd", "numbers", "good", "hard", "pairs", "common", "fit")
#: What is counted in every line.
LINE_COUNTS = ("chars", "lines", "ended", "low", "long", "cells", "cell_words", "entries", "short_entries", "sentence_words", "short")
COUNTS = (*TOKEN_COUNTS, *LINE_COUNTS)
# What draws a table or a bullet and is no word; numbers; words as they are written; strings that no language writes.
_DRAWN = regex.compile(r"[-+=_:•▪·–—]+")
_NUMBER = regex.compile(r"[-−+(\[|]?\d[\d.,]*[.,;:)\]|]?")
_GOOD = regex.compile(r"(?<![^\s(\[\"'«¿¡“-])(?:\p{Lu}?[\p{Ll}\p{M}]+|\p{Lu}+|[\p{Lo}\p{M}]+)(?![^\s.,;:!?)\]\"'»।”-])")
_HARD = regex.compile(r"(?<![\p{L}\p{N}])(?i:[b-df-hj-np-tv-xz]{3,})(?![\p{L}\p{N}])|\p{Ll}\p{Lu}|\p{L}\d\p{L}|(?i:[b-df-hj-np-tv-xz]{6,})")
_USUAL, _MARKS = frozenset(".,;:!?'\"()[]/%+=×−-"), " \t([{\"'«¿¡“”»}]).,;:!?।-"
# Fixed values, as RE2 reads them: rows of cells by their mark, entries of a list, ends of sentences.
_CELLS = {"|": r"\|[^|]*\||\S\s+\|\s+\S", "\t": r"\S\t|\t\S", "   ": r"\S {3,}\S", ";": r";[^;\s]*;|;[^;]*;[^\s;]|;[^\s;][^;]*;|^\s*[\w.]+;\S"}
_RULE = r"^[\s|+=_:-]+$"
_ENTRY = r"^\s*(?:[-•▪◦‣*·–—o]|\(?\p{L}\)|\(?\d{1,3}[.)]|\d+(?:\.\d+)+\.?|\(?[ivxIVX]+[.)])\s+\S"
_ENDED = r"[.!?।][\"'”»)\]]*\s*(?:\[[^\]]{0,6}\]?|\(\d+\)|\d{1,3})?$"
_LOW = r"^\s*\p{Ll}"


class _Tokens:
    """Counts of tokens, each taken once a worker: words of a language come again and again."""

    def __init__(self, logp: np.ndarray, common: frozenset[str]) -> None:
        self.logp, self.common = logp.tolist(), common
        self.seen: dict[str, int] = {}
        self.table = np.zeros((0, len(TOKEN_COUNTS)))

    def _measured(self, token: str) -> tuple:
        letters = digits = symbols = odd = pairs = 0
        for ch in token:
            kind = unicodedata.category(ch)[0]
            if kind == "L":
                letters += 1
            elif kind == "N":
                digits += 1
            elif kind != "M":
                symbols += 1
                odd += ch not in _USUAL
        fit, last = 0.0, 0
        for ch in token.lower():
            cp = ord(ch)
            now = cp - 96 if 97 <= cp <= 122 else 27 if 0xC0 <= cp < 0x2000 and cp not in (0xD7, 0xF7) else 0
            if last and now:
                fit, pairs = fit + self.logp[last][now], pairs + 1
            last = now
        common = sum(w.strip(_MARKS) in self.common for w in token.lower().replace("-", " ").split())
        word = not _DRAWN.fullmatch(token)
        return word, letters, digits, symbols, odd, bool(_NUMBER.fullmatch(token)), len(_GOOD.findall(token)), len(_HARD.findall(token)), pairs, common, fit

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen, self.table = {}, self.table[:0]
        new = [t for t in tokens if t not in self.seen]
        if new:
            self.seen.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.array([self._measured(t) if t else (0,) * len(TOKEN_COUNTS) for t in new], float)])
        return self.table[np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))]


def _counter(key: str, logp: np.ndarray, common: frozenset[str]):
    """Sums of COUNTS over the lines of each page and value of _out in a batch of key, line, _out."""
    tokens = _Tokens(logp, common)

    def of_lines(lines: pa.Array) -> np.ndarray:
        # Cells are words of their own.
        spread = pc.utf8_trim_whitespace(pc.replace_substring(pc.replace_substring(lines, ";", " "), "|", " "))
        parts = pc.utf8_split_whitespace(spread)
        coded = pc.dictionary_encode(parts.flatten())
        each = tokens.rows(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)] if len(coded) else np.zeros((0, len(TOKEN_COUNTS)))
        at = np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
        run = np.concatenate([np.zeros((1, len(TOKEN_COUNTS))), np.cumsum(each, 0)])
        got = dict(zip(TOKEN_COUNTS, (run[at[1:]] - run[at[:-1]]).T, strict=True))
        bars, semis = (np.asarray(pc.count_substring(lines, m)) for m in "|;")
        got["symbols"], got["odd"] = got["symbols"] + bars + semis, got["odd"] + bars
        has = lambda p: np.asarray(pc.match_substring_regex(lines, p))
        cell = has(_RULE)
        for mark, pattern in _CELLS.items():
            maybe = np.asarray(pc.match_substring(lines, mark))
            if maybe.any():
                cell[maybe] |= np.asarray(pc.match_substring_regex(lines.filter(pa.array(maybe)), pattern))
        words, entry = got["words"], has(_ENTRY) & ~cell
        got |= {
            "chars": np.asarray(pc.utf8_length(lines)), "lines": np.ones(len(lines)), "ended": has(_ENDED), "low": has(_LOW), "long": words >= 7, "cells": cell, "cell_words": np.where(cell, words, 0),
            "entries": entry, "short_entries": entry & (words <= 7), "sentence_words": np.where(~cell & (words >= 6), words, 0), "short": (words <= 4) & ~cell,
        }
        return np.stack([np.asarray(got[c], float) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            out = np.asarray(b.column("_out"), np.int64)
            page = pc.dictionary_encode(b.column(key))
            group, first, where = np.unique(np.asarray(page.indices, np.int64) * 2 + out, return_index=True, return_inverse=True)
            sums = [np.bincount(where, weights=v, minlength=len(group)) for v in of_lines(b.column("line"))]
            cols = [b.column(key).take(pa.array(first)), pa.array(group % 2), *[pa.array(v) if c == "fit" else pa.array(np.rint(v).astype(np.int64)) for c, v in zip(COUNTS, sums, strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "_out", *COUNTS])

    return run


def _figures() -> dict[str, Column]:
    """The figures of a page, from the sums over its lines."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("words"), "mean_word_length": per("letters", "words"), "symbol_ratio": per("symbols", "chars"),
        "implausible_ratio": F.greatest(F.lit(0.0), F.lit(1.0) - (F.col("good") + F.col("numbers")) / F.greatest("words", F.lit(1))),
        "common_ratio": per("common", "words"), "ended_ratio": per("ended", "lines"), "digit_ratio": per("digits", "chars"), "odd_ratio": per("odd", "chars"),
        "hard_ratio": per("hard", "words"), "number_ratio": per("numbers", "words"), "words_per_line": per("words", "lines"), "low_ratio": per("low", "lines"),
        "long_ratio": per("long", "lines"), "cell_ratio": per("cells", "lines"), "cell_words": per("cell_words", "words"), "entry_ratio": per("entries", "lines"),
        "short_entry_ratio": per("short_entries", "lines"), "sentence_ratio": per("sentence_words", "words"), "short_ratio": per("short", "lines"), "pair_fit": per("fit", "pairs"), "lines": F.col("lines"),
    }


def figures(lines: DataFrame, logp: np.ndarray, furniture: DataFrame | None = None, key: str = "page_id", common: tuple[str, ...] = tuple(COMMON)) -> DataFrame:
    """key and the figures of every page with lines, without those of furniture unless nothing else is there. Lines with
    null key don't count. common: the common words of the languages at hand."""
    rows = lines.where(F.col(key).isNotNull())
    if furniture is None:
        rows = rows.select(key, "line", F.lit(0).alias("_out"))
    else:
        f = furniture.select(F.col(key).alias("_k"), F.col("line_no").alias("_l"), F.lit(1).alias("_f")).distinct()
        rows = rows.join(f, (rows[key] == f["_k"]) & (rows["line_no"] == f["_l"]), "left").select(key, "line", F.coalesce("_f", F.lit(0)).alias("_out"))
    shape = ", ".join([f"`{key}` {dict(lines.dtypes)[key]}", "_out long", *[f"{c} {'double' if c == 'fit' else 'long'}" for c in COUNTS]])
    each = rows.mapInArrow(_counter(key, logp, frozenset(common)), shape)
    own = each.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("_out") == 0, F.col(c))), F.sum(c)).alias(c) for c in COUNTS])
    return own.select(key, *[x.alias(c) for c, x in _figures().items()])


#: What the trees see of a page's figures.
FEATURES = (
    "mean_word_length symbol_ratio implausible_ratio common_ratio ended_ratio digit_ratio odd_ratio hard_ratio number_ratio words_per_line low_ratio"
    " long_ratio cell_ratio cell_words entry_ratio short_entry_ratio sentence_ratio short_ratio pair_fit"
).split()


def weak_label() -> Column:
    """What a page plainly holds; null where the signs disagree."""
    f = F.col
    odd = (f("implausible_ratio") >= 0.45) | (f("hard_ratio") >= 0.35) | (f("pair_fit") < STRANGE)
    junk = odd & ((f("common_ratio") < 0.12) | (f("implausible_ratio") >= 0.6))
    table = (f("cell_ratio") >= 0.6) & (f("cell_words") >= 0.6) & (f("implausible_ratio") < 0.3) & (f("pair_fit") >= STRANGE)
    prose = (f("common_ratio") >= 0.27) & (f("implausible_ratio") < 0.3) & (f("cell_words") < 0.45) & (f("sentence_ratio") >= 0.3) & (f("short_entry_ratio") + f("short_ratio") < 0.6)
    entries = (f("short_ratio") >= 0.5) | (f("short_entry_ratio") >= 0.5) | (f("entry_ratio") >= 0.6) | ((f("common_ratio") < 0.12) & (f("low_ratio") < 0.5))
    listed = (f("cell_words") < 0.3) & (f("common_ratio") < 0.27) & ~odd & entries & (f("number_ratio") < 0.6)
    return F.when(junk, "junk").when(table, "table").when(prose, "prose").when(listed, "list")


def train(pages: DataFrame, key: str = "page_id", sample: int = SAMPLE, holdout: DataFrame | None = None) -> boosting.Boosted:
    """Trees on the figures of a bounded sample of weakly labelled pages, calibrated on the hand-checked holdout."""
    drawn = pages.withColumn("_label", weak_label()).where("_label is not null").select(key, "_label", *FEATURES)
    n = {r["_label"]: r["count"] for r in drawn.groupBy("_label").count().collect()}
    share = F.coalesce(*[F.when(F.col("_label") == k, F.lit(min(1.0, sample / len(KINDS) / v))) for k, v in n.items()], F.lit(1.0)) if n else F.lit(1.0)
    rows = drawn.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64(key)).limit(2 * sample).toPandas()
    model = boosting.Boosted(KINDS).fit(rows[FEATURES].to_numpy(float), rows["_label"].to_numpy(object))
    if holdout is not None:
        held = holdout.toPandas()
        model.calibrate(held[FEATURES].to_numpy(float), held["kind"].to_numpy(object))
    return model


def classify(pages: DataFrame, model: boosting.Boosted, key: str = "page_id") -> DataFrame:
    """Adds kind and its calibrated probability to the figures."""
    shape = ", ".join([*[f"`{c}` {t}" for c, t in pages.dtypes], "kind string", "probability double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.probabilities(b[FEATURES].to_numpy(float))
            yield b.assign(kind=np.array(KINDS, object)[p.argmax(1)] if len(b) else [], probability=p.max(1) if len(b) else [])

    return pages.mapInPandas(run, shape)


def page_kinds(pages: DataFrame, lines: DataFrame | None = None, furniture: DataFrame | None = None, holdout_texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, figures, kind, probability of every page with a text that isn't blank.

    pages: page_id, file_id, page_no, text, one row a page. Running lines and page numbers don't count. Pages with null,
    empty or blank text aren't in the result.
    """
    from chronopanel.llm.holdout import HOLDOUT

    spark = pages.sparkSession
    lines = lines if lines is not None else page_lines(pages, "page_id", "text", "file_id", "page_no")
    furniture = furniture if furniture is not None else page_furniture(lines)
    logp = letter_pairs(lines)
    stats = cut(figures(lines, logp, furniture))
    held = holdout_texts or HOLDOUT
    hand = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(held)], "page_id long, kind string, text string")
    checked = figures(page_lines(hand, "page_id", "text"), logp).join(hand.select("page_id", "kind"), "page_id")
    return classify(stats, train(stats, holdout=checked))
