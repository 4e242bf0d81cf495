"""Files to pages of text: kinds by their first bytes, plain text in several encodings, word-processor documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
PAGES = "path string, page_no int, text string, method string, error string"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content, sha256, kind of the files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.withColumn("sha256", F.sha2("content", 256)).withColumn("kind", sniff(F.col("content"), F.col("path")))


def sniff(content: Column, path: Column) -> Column:
    """pdf, docx, image, doc (old, not read) or text, by the first bytes, then by the name."""
    h = F.hex(F.substring(content, 1, 8))
    low = F.lower(path)
    return (
        F.when(h.startswith("25504446"), "pdf").when(h.startswith("504B0304") & low.endswith(".docx"), "docx").when(h.startswith("D0CF11E0"), "doc")
        .when(h.startswith("89504E47") | h.startswith("FFD8FF") | h.startswith("47494638") | h.startswith("49492A00"), "image").when(low.rlike(r"\.(txt|md|csv|text)$"), "text").otherwise("unknown")
    )


def decode(data: bytes) -> str:
    """UTF-8 with or without mark, UTF-16 by its mark, else the Western code page, else Latin 1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def docx_pages(data: bytes) -> list[str]:
    """Pages of a document: paragraphs in order, cells of a table row four spaces apart, numbers of lists counted up,
    formulas as their text, page breaks where the file has them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    pages: list[list[str]] = [[]]
    counts: dict[tuple[str, int], int] = {}

    def paragraph(p: ElementTree.Element) -> str:
        parts: list[str] = []
        num = p.find(f"{_W}pPr/{_W}numPr")
        if num is not None:
            of, level = num.find(f"{_W}numId"), num.find(f"{_W}ilvl")
            key = (of.get(f"{_W}val") if of is not None else "0", int(level.get(f"{_W}val")) if level is not None else 0)
            counts[key] = counts.get(key, 0) + 1
            for other in [k for k in counts if k[0] == key[0] and k[1] > key[1]]:
                counts[other] = 0
            parts.append(f"{counts[key]}. ")
        for node in p.iter():
            if node.tag in (f"{_W}t", f"{_M}t"):
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("    ")
            elif node.tag == f"{_W}br":
                parts.append("\f" if node.get(f"{_W}type") == "page" else "\n")
        return "".join(parts)

    for block in body if body is not None else []:
        if block.tag == f"{_W}p":
            first, *rest = paragraph(block).split("\f")
            pages[-1].append(first)
            for more in rest:
                pages.append([more])
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                pages[-1].append("    ".join(" ".join(paragraph(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc")))
    return ["\n".join(p).strip("\n") for p in pages]


def extract_pages(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """path, page_no, text, method, error of files of read_files(). readers: kind -> function of bytes to pages, for kinds
    beyond text and docx (PDF, images), as plug-ins; a kind without a reader or a broken file gives a row with its error."""
    table = {"text": lambda data: decode(data).split("\f"), "docx": docx_pages} | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, content in zip(b["path"], b["kind"], b["content"], strict=True):
                try:
                    if kind not in table:
                        raise ValueError(f"no reader for {kind}")
                    rows += [(path, i, t, kind, None) for i, t in enumerate(table[kind](bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001 - a broken file is a result
                    rows.append((path, None, None, kind, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "method", "error"]).astype({"page_no": "Int32"})

    return files.select("path", "kind", "content").mapInPandas(run, PAGES)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't known yet, one a content."""
    return files.join(known.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def lines_of_boxes(boxes: DataFrame, keys: list[str], gap: float = 4.0) -> DataFrame:
    """keys, text: words of boxes (x, width, word) put to lines; a gap of more than so many median character widths
    becomes four spaces."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("x")
    char = F.median(F.col("width") / F.greatest(F.length("word"), F.lit(1))).over(W.partitionBy(*keys))
    far = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w) > gap * F.col("_char")
    x = boxes.withColumn("_char", char).withColumn("_sep", F.when(F.lag("x").over(w).isNull(), "").when(far, "    ").otherwise(" "))
    parts = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", F.concat("_sep", "word").alias("t")))).alias("p"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda v: v["t"]), "").alias("text"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style).*?</\1>|<[^>]+>", " "), r"\s+", " "))


