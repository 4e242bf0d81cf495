"""Readers of the parquet tables and the one place where intermediate tables are kept."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set in `sf_dir`; columns are pruned and filters pushed by the caller's plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="chronopanel-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, as in tests, one of this process, but only if
    the executors are this process, too; on a cluster that is an error, for their files would lie on different machines."""
    if path := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own_folder()


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: later plans start there and survive the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_each(parts: list[DataFrame]) -> DataFrame:
    """cut() of the parts' union by name, each part by a plan of its own: what the driver holds grows with the largest plan
    that it runs, for every stage of a plan plans the whole of it again."""
    whole = functools.reduce(DataFrame.unionByName, parts)
    spark = whole.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    for df in parts:
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in whole.schema]).write.mode("append").parquet(path)
    out = spark.read.schema(whole.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table of cut() that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
