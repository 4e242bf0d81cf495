"""The package's own code to the Python workers, where they don't have it on their path."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


@functools.cache
def _archive() -> str:
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="chronopanel-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/chronopanel.zip"
    with ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Once a Spark application: the driver serves an archive of the package, which workers put on their path."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        sc.addPyFile(_archive())
        _SHIPPED.add(sc.applicationId)


def shipped(query):
    """The query, with the code shipped first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
