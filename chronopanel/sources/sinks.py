"""Results to files: partitioned tables, CSV, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_run(df: DataFrame, path: str, run_id: int) -> None:
    """Results of one run; a run saved again replaces its own partition and no other."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of the greatest run_id."""
    top = df.agg(F.max("run_id").alias("_top"))
    return df.join(F.broadcast(top), F.col("run_id") == F.col("_top")).drop("_top")  # one row


def export_csv(df: DataFrame, path: str) -> None:
    """Arrays and structs as JSON; the header names the columns."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One column json: every row as an object; what isn't a number becomes null."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean)).alias("json"))


def cached_vectors(texts: DataFrame, cache: DataFrame, encode, backend: str) -> tuple[DataFrame, DataFrame]:
    """(all, new): vectors of texts by the hash of backend and text, from the cache or encoded; encode maps a table with
    column text to one with column vector beside."""
    keyed = texts.withColumn("key", F.sha2(F.concat(F.lit(backend + "\x1f"), F.coalesce("text", F.lit(""))), 256))
    known = keyed.join(cache.select("key", "vector"), "key", "left")
    new = encode(known.where("vector is null").select("key", "text").dropDuplicates(["key"])).select("key", "vector")
    return keyed.join(cache.select("key", "vector").unionByName(new), "key"), new
