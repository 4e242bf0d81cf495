"""Lines of pages, and the running headers and footers among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.text import roman_or_int
from chronopanel.llm.lookalikes import forms
from chronopanel.sources.tables import cut

#: Lines from either end of a page, blank ones not counted, where headers, footers and page numbers stand.
EDGE = 4
#: A line is running if it stands on at least two pages of its file, and on this share of them.
RUNNING_SHARE = 0.3
#: Glyph sequences and glyphs that scanning takes for one another; each stands for its class.
MERGED = (("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"))
#: Further pairs, of which one at a time is replaced.
SINGLE_MERGED = (("in", "m"), ("li", "h"), ("nn", "rm"))
CONFUSED = ("ce€¢", "il1|", "ao0", "s5", "tf", "uv", "hb6", "gq")
#: How the number of a page is written.
PAGE_NUMBER = r"^\s*(?:[-–~\[(]\s*)?(?:[Pp][a@o][gq][ec€]\s+)?(?:[0-9lIoO|]{1,4}|[ivxl1|]{1,7})(?:\s*(?:/|[o0a][ft])\s*[0-9lIoO|]{1,4})?(?:\s*[-–~\])])?\s*$"


_MERGES = [MERGED, (), *[(pair,) for pair in SINGLE_MERGED]]
#: Fixed value: a number, if some of its digits are misread.
_NUMBER = regex.compile(r"(?<![\p{L}\p{N}])[0-9lIoO|]*[0-9][0-9lIoO|]*(?![\p{L}\p{N}])")
_DIGITS = str.maketrans("lIoO|", "11001")


_CLASS = np.arange(0x110000, dtype=np.uint32)
for _c in CONFUSED:
    _CLASS[[ord(ch) for ch in _c[1:]]] = ord(_c[0])


def _skeleton_hashes(lines: list[str]) -> list[np.ndarray]:
    """A hash of each of the skeletons() of all lines, which are worked on as one text."""
    if not lines:
        return [np.empty(0, np.uint64) for _ in _MERGES]
    low, out = ("\n".join([" ".join(x.split()) for x in lines]) + "\n").lower(), []
    for i, merged in enumerate(_MERGES):
        x = low
        for a, b in merged:
            x = x.replace(a, b)
        codes = _CLASS[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        ends = np.flatnonzero(codes == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(len(codes)) - np.repeat(starts, ends - starts + 1)
        powers = np.cumprod(np.full(int((ends - starts).max()) + 1, np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * i)))
        out.append(_mixed(np.add.reduceat(codes * powers[place], starts)))
    return out


def _mixed(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        x = (x ^ p) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def _keyed(key: str, file: str, page_no: str):
    """One row a key of an edge line: a hash of its file and of one of its skeletons, as it is and with each of its numbers
    masked in turn (taken out at either end), then with what that number is more than page_no. Numbers inside a line count in
    the two outer lines alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, pages, outer = b.column("line"), b.column(page_no).to_pylist(), b.column("outer").to_pylist()
            row, masked, off = [], [], []
            for i in np.flatnonzero(np.asarray(pc.match_substring_regex(lines, "[0-9]"))):
                if pages[i] is None:
                    continue
                line = lines[i].as_py()
                for m in _NUMBER.finditer(line):
                    if len(digits := m[0].translate(_DIGITS)) <= 6:
                        left, right = line[: m.start()], line[m.end() :]
                        if not outer[i] and left.strip() and right.strip():
                            continue
                        row.append(i)
                        off.append(int(digits) - pages[i])
                        masked.append(f"{left}#{right}" if left.strip() and right.strip() else left + right)  # at either end
            whole, some = _skeleton_hashes(lines.to_pylist()), _skeleton_hashes(masked)
            every, row = np.arange(len(lines)), np.array(row, np.int64)
            of = pd.util.hash_array(np.asarray(b.column(file).cast(pa.string()).to_pylist(), object), categorize=False) if len(lines) else np.empty(0, np.uint64)
            moved = np.array(off, np.int64).view(np.uint64)
            h = [_mixed(of, x) for x in whole] + [_mixed(of[row], x, moved, np.full(len(row), 7, np.uint64)) for x in some]
            at = np.concatenate([every] * len(whole) + [row] * len(some))
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column(file).take(at), b.column("line_no").take(at), pa.array(np.concatenate(h).view(np.int64))], names=[key, file, "line_no", "h"])

    return run


def skeletons(text: Column) -> Column:
    """All skeletons of a text, each marked with the glyph pairs that it merges: texts that one misreading tells apart
    share one."""
    return F.array(*[F.concat(F.lit(f"{i}:"), skeleton(text, m)) for i, m in enumerate(_MERGES)])


def skeleton(text: Column, merged: tuple = MERGED) -> Column:
    """Lower case with confusable glyphs replaced by one of their class, white space collapsed."""
    x = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    for a, b in merged:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.translate(x, "".join(c[1:] for c in CONFUSED), "".join(c[0] * (len(c) - 1) for c in CONFUSED))


def page_lines(pages: DataFrame, key: str = "page_id", text: str = "text", *keep: str) -> DataFrame:
    """key, keep, line_no (blank lines counted, from 1), line, top, bottom: the lines that aren't blank, in their consistent
    form; top and bottom number them from either end from 0. Null and empty texts have none."""
    whole = forms(pages, text, key, *keep)
    numbered = F.transform(F.split("form", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.rtrim(x).alias("line")))
    filled = whole.select(key, *keep, F.filter(numbered, lambda x: x["line"].rlike(r"[^\s]")).alias("_l"))
    each = filled.select(key, *keep, F.size("_l").alias("_n"), F.posexplode("_l").alias("top", "_x"))
    return each.select(key, *keep, F.col("_x.line_no").alias("line_no"), F.col("_x.line").alias("line"), "top", (F.col("_n") - 1 - F.col("top")).alias("bottom"))


def page_furniture(lines: DataFrame, key: str = "page_id", file: str = "file_id", page_no: str = "page_no") -> DataFrame:
    """key, line_no, kind (`running`, `page_number`) of the lines of page_lines() that aren't the page's own text.

    Only lines near either end count. A page number is the first or last line and holds nothing else; a bare or bracketed
    number or numeral counts only if it is page_no, or as far from it as on another page of the file. Running lines are grouped
    by their glyph skeleton, as they are and with each of their numbers masked in turn, if that number is as far from
    page_no on each page. Pages without a file have no running lines, nor have lines further than EDGE from either end.
    """
    edge = lines.where((F.col("top") < EDGE) | (F.col("bottom") < EDGE)).select(key, file, page_no, "line_no", "line", "top", "bottom")
    number = edge["line"].rlike(PAGE_NUMBER)
    # What the line may say, as digits or as a numeral, if some glyphs are misread; and how far that is from page_no.
    digits = F.nullif(F.regexp_extract(F.translate("line", "lIoO|", "11001"), r"\d{1,4}", 0), F.lit("")).try_cast("long")
    numeral = roman_or_int(F.regexp_replace(F.translate(F.lower("line"), "l1|", "iii"), r"[^ivx]", "")).cast("long")
    said = F.array_distinct(F.filter(F.array(digits - F.col(page_no), numeral - F.col(page_no)), lambda x: x.isNotNull()))
    plain = edge["line"].rlike(r"^\s*[\[(]?\s*[0-9lIoO|ivx]+\s*[\])]?\s*$")
    maybe = edge.where(number & ((F.col("top") < 2) | (F.col("bottom") < 2))).select(key, file, "line_no", ((F.col("top") == 0) | (F.col("bottom") == 0)).alias("outer"), plain.alias("plain"), F.explode_outer(said).alias("off"))
    usual = maybe.where(F.col("outer") & F.col(file).isNotNull()).groupBy(F.col(file).alias("_uf"), F.col("off").alias("_uo")).agg(F.count_distinct(key).alias("_un")).where("_un >= 2")
    at = maybe.join(usual, (F.col(file) == F.col("_uf")) & (F.col("off") == F.col("_uo")), "left")
    fits = (F.col("off") == 0) | F.col("_un").isNotNull()
    numbered = at.where(fits | (F.col("outer") & ~F.col("plain"))).select(key, "line_no", F.lit("page_number").alias("kind")).distinct()
    rest = edge.where(~number & F.col(file).isNotNull())
    kinds = dict(lines.dtypes)
    shape = f"`{key}` {kinds[key]}, `{file}` {kinds[file]}, line_no {kinds['line_no']}, h long"
    outer = (F.col("top") < 2) | (F.col("bottom") < 2)
    keyed = cut(rest.select(key, file, page_no, "line_no", "line", outer.alias("outer")).mapInArrow(_keyed(key, file, page_no), shape))
    # Nearly all keys are alone; only those of several pages are counted page by page.
    several = keyed.groupBy("h").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).where("_lo <> _hi").select("h")
    shared = cut(keyed.join(several, "h", "left_semi"))
    size = lines.groupBy(file, key).agg(F.lit(1).alias("one")).groupBy(F.col(file).alias("_file")).agg(F.count("*").alias("_pages"))
    spread = shared.groupBy(file, "h", key).agg(F.lit(1).alias("one")).groupBy(file, "h").agg(F.count("*").alias("n"))
    often = spread.join(size, spread[file] == size["_file"]).where(F.col("n") >= RUNNING_SHARE * F.col("_pages")).select("h")
    running = shared.join(often, "h", "left_semi").select(key, "line_no").distinct()
    return numbered.unionByName(running.select(key, "line_no", F.lit("running").alias("kind")))
