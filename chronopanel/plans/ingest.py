"""Queries of parsing, sources and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronopanel.operators import parsing as P
from chronopanel.plans.panels import PANEL, cells, rounded
from chronopanel.plans.reporting import questions
from chronopanel.sources.tables import shared_folder, table
from chronopanel.sources.files import sniff
from chronopanel.streaming import flows as S


def _pages(spark, d):
    return table(spark, d, "document_page").where("page_id is not null and text is not null").select("page_id", "file_id", "page_no", "text").distinct()


def _exam_pages(spark, d):
    f = table(spark, d, "source_file").where("kind = 'exam'").select("file_id").distinct()
    return _pages(spark, d).join(f, "file_id", "left_semi")


def _streamed(spark, make):
    """What a stream over existing files gives, as a table."""
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    S.run_to_table(make(at), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


def _state(spark, d):
    """The state of each item after its last step, of a stream whose files come in no order."""

    def make(at):
        c = cells(spark, d).select((F.col("course_id") * 1_000_000 + F.col("k")).alias("k"), "t", "y")
        c.repartition(6, F.xxhash64("t")).write.parquet(f"{at}/in")
        return S.item_state(S.file_stream(spark, f"{at}/in", "k long, t int, y long", per_trigger=2))

    last = S.newest(_streamed(spark, make), "version", "k", "t")
    return last.groupBy("k").agg(F.max("seen").alias("seen"), F.max("t").alias("t"), F.count("*").alias("steps"), F.max_by("streak", "t").alias("streak"), F.max_by("since", "t").alias("since"))


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _windows(spark, d):
    """Daily counts and sums of events by kind, from a stream."""
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    e = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    S.run_updates(S.windowed_counts(e, "ts", "event_type", length="1 day", delay="0 seconds", value="value"), f"{at}/out", f"{at}/checkpoint")
    out = S.newest(spark.read.parquet(f"{at}/out"), "_batch", "start", "event_type")
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"))


def _batch_windows(spark, d):
    e = table(spark, d, "events")
    return rounded(e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"))


def _sessions(spark, d):
    e = table(spark, d, "events").where("user_id is not null")
    s = e.groupBy(F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


QUERIES = {
    "paper_lines": lambda s, d: P.paper_lines(_exam_pages(s, d)).groupBy("file_id", "kind").agg(F.count("*").alias("n")),
    "parse_papers": lambda s, d: P.parse_papers(_exam_pages(s, d)),
    "parse_syllabus": lambda s, d: P.parse_syllabus(_pages(s, d).join(table(s, d, "source_file").where("kind = 'syllabus'").select("file_id").distinct(), "file_id", "left_semi")),
    "split_sequential": lambda s, d: P.split_sequential(questions(s, d, "text")),
    "equations": lambda s, d: P.equations(_pages(s, d), "page_id", "text"),
    "sniffed_names": lambda s, d: table(s, d, "source_file").select("file_id", "filename").distinct().select("file_id", sniff(F.when(F.col("filename").endswith(".pdf"), F.lit("%PDF-1.7")).when(F.col("filename").endswith(".png"), F.unhex(F.lit("89504E470D0A1A0A")).cast("string")).otherwise(F.lit("text")), F.col("filename")).alias("kind")),
    "stream_item_state": _state,
    "stream_windows": _windows,
    "event_windows": _batch_windows,
    "event_sessions": _sessions,
}
_DAYS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value) + 1e-10, 6) AS total FROM events GROUP BY ALL"
ORACLES = {
    "stream_windows": _DAYS,
    "stream_item_state": PANEL
    + ", o AS (SELECT course_id, k, max(t) AS t, sum(y)::BIGINT AS seen, count(*) AS steps, coalesce(max(CASE WHEN y > 0 THEN t END), -1) AS one, coalesce(max(CASE WHEN y = 0 THEN t END), -1) AS nil FROM cells GROUP BY ALL) SELECT course_id * 1000000 + k AS k, seen, t, steps, CASE WHEN one > nil THEN (SELECT count(*) FROM cells c WHERE c.course_id = o.course_id AND c.k = o.k AND c.t > nil) ELSE 0 END::INT AS streak, CASE WHEN nil > one THEN (SELECT count(*) FROM cells c WHERE c.course_id = o.course_id AND c.k = o.k AND c.t > one) ELSE 0 END::INT AS since FROM o",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value) + 1e-10, 6) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WHERE user_id IS NOT NULL), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM c GROUP BY 1",
}
