"""Structured Streaming: files once by content, windowed counts of late events, and per-item state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def once_by_content(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Rows of which no equal key came within the delay; the state of older ones is dropped."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")


def windowed_counts(stream: DataFrame, at: str, *keys: str, length: str = "1 hour", slide: str | None = None, delay: str = "2 hours", value: str | None = None) -> DataFrame:
    """window start and end, keys, n and total: tumbling windows, or sliding ones; rows later than the delay are left out."""
    w = F.window("_at", length, slide) if slide else F.window("_at", length)
    x = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).groupBy(w.alias("w"), *keys)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return x.agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """key, start, end, n of runs of events no further apart than the gap."""
    x = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return x.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def item_state(stream: DataFrame, key: str = "k") -> DataFrame:
    """key, t, seen, streak, since, version: rolling state of each item after each of its steps (key, t, y).

    Steps may come in any order. One that comes late changes those after it, which come out again with a higher version,
    the number of steps known; newest() keeps the last one of each. A step that comes twice counts once, by its greatest y.
    """
    out = f"{key} long, t int, seen long, streak int, since int, version int"

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        first = None
        for b in batches:
            for t, y in b[["t", "y"]].itertuples(index=False):
                if known.get(t, -1) < int(y > 0):
                    known[int(t)] = int(y > 0)
                    first = int(t) if first is None else min(first, int(t))
        seen, streak, since, rows = 0, 0, 0, []
        for t in sorted(known) if first is not None else ():
            seen += known[t]
            streak, since = (streak + 1, 0) if known[t] else (0, since + 1)
            if t >= first:
                rows.append((k[0], t, seen, streak, since, len(known)))
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return stream.groupBy(key).applyInPandasWithState(step, out, "ts array<int>, ys array<int>", "append", "NoTimeout")


def newest(rows: DataFrame, version: str, *keys: str) -> DataFrame:
    """The row of the greatest version of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("_r")).select("_r.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now to a table of files, exactly once over restarts with the same checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now in update mode: every batch adds the rows that it changed, marked with its number (`_batch`), so
    that windows that no later event closes are there, too. A batch that runs twice overwrites itself."""

    def add(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Batches after which the parts of an upserted table are merged.
MERGED_AFTER = 20


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str, seq: str) -> None:
    """The last row of each key. A batch adds its own last rows as a part; every MERGED_AFTER batches all parts up to then
    become one. read_upserted() gives the table. A batch that runs twice overwrites itself."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        rows = newest(batch, seq, key)
        if n and n % MERGED_AFTER == 0:
            rows = newest(rows.unionByName(read_upserted(spark, path, key, seq, n).select(rows.columns)), seq, key)
            rows.write.mode("overwrite").parquet(f"{path}/merged={n}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_upserted(spark: SparkSession, path: str, key: str, seq: str, below: int | None = None) -> DataFrame:
    """The table of upsert_batches(): the last merged part and the parts after it, of batches below a number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [tuple(x.getPath().getName().split("=")) for x in fs.listStatus(folder)]
    numbered = {(kind, int(n)) for kind, n in parts if below is None or int(n) < below}
    start = max((n for kind, n in numbered if kind == "merged"), default=-1)
    keep = [f"{path}/{kind}={n}" for kind, n in sorted(numbered) if (kind, n) == ("merged", start) or (kind == "batch" and n > start)]
    return newest(spark.read.parquet(*keep), seq, key)
