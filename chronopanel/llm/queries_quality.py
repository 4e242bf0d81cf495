"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.llm import pages as P
from chronopanel.llm import quality as Q
from chronopanel.llm.queries_pages import pages
from chronopanel.sources.tables import cut, table


def read(spark, d):
    """Pages, their lines, and the furniture among the lines, of document_page."""
    p = pages(spark, d, "file_id", "page_no", "method", "ocr_confidence")
    lines = cut(P.page_lines(p, "page_id", "text", "file_id", "page_no", "method", "ocr_confidence"))
    return p, lines, cut(P.page_furniture(lines))


def kinds(spark, d):
    p, lines, furniture = read(spark, d)
    return Q.page_kinds(p, lines, furniture)


def _found(spark, d):
    return kinds(spark, d).where("kind <> 'prose'").select("page_id", "kind")


def _report(spark, d):
    """Every page, those without text too, with the figures of a quality report; flags name what is out of the ordinary."""
    every = table(spark, d, "document_page").where("page_id is not null").select("page_id").distinct()
    stats = kinds(spark, d).withColumnRenamed("page_id", "_id")
    flags = F.filter(
        F.array(
            F.when(F.col("_id").isNull(), "empty"), F.when(F.col("symbol_ratio") > 0.25, "garbled"), F.when(F.col("implausible_ratio") > 0.3, "implausible"),
            F.when(F.col("words") < 5, "short"), F.when(F.col("kind") != "prose", F.col("kind")),
        ),
        lambda x: x.isNotNull(),
    )
    out = every.join(stats, every["page_id"] == stats["_id"], "left")
    ratios = [F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "implausible_ratio", "common_ratio", "ended_ratio", "probability")]
    return out.select("page_id", F.coalesce("words", F.lit(0)).cast("long").alias("words"), *ratios, "kind", flags.alias("flags"))


QUERIES = {"p1_found": _found, "p1_report": _report}
ORACLES: dict[str, str] = {}
